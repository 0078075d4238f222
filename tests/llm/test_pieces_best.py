"""The segmentation of a word against a plain one that tries every piece at every place."""

import random

from usagelens.llm import pieces as P
from usagelens.llm.queries import tokenizer


def plain(p, text):
    best = [(0.0, [])]
    for end in range(1, len(text) + 1):
        found = []
        for at in range(max(0, end - p.longest), end):
            name = text[at:end]
            score = p.scores.get(name, p.penalty if end - at == 1 else None)
            if score is not None:
                found.append((best[at][0] + score, -at, at))
        score, _, at = max(found, key=lambda f: (f[0], f[1]))
        best.append((score, best[at][1] + p.piece(text[at:end])))
    return best[-1][1]


def test_best_tries_every_piece():
    p, rnd = P.pieces(tokenizer("piece_bpe_32k.model")), random.Random(7)
    words = ["", "▁", "▁the", "▁international", "€", "▁😀x"] + ["".join(rnd.choice("▁aehtins\nß中.0") for _ in range(rnd.randint(1, 24))) for _ in range(400)]
    assert [p.best(w) for w in words] == [plain(p, w) for w in words]
