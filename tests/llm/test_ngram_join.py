import random

from usagelens.llm import ngram_join


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def linked(x, y):
    return bool(x and y) and 100 * len(x & y) >= 75 * len(x | y)


def brute(rows):
    """(doc_id, size, smallest doc_id reachable), by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if comp[a] > comp[b] and linked(sets[a], sets[b]):
                    comp[a], changed = comp[b], True
    return sorted((i, len(sets[i]), comp[i]) for i in sets)


def jobs(spark):
    """Number of the next job."""
    group = f"mark-{random.random()}"
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", group)
    spark.sparkContext.parallelize([1], 1).count()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return max(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = jobs(spark)
    out = sorted(map(tuple, ngram_join.similar_documents(docs).collect()))
    return out, jobs(spark) - before - 1


def prose(seed, n=60):
    rng = random.Random(seed)
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def test_chains_groups_and_common_lines(spark):
    rows, common = [], prose(1, 12)
    chain = prose(2)
    for i in range(40):                                    # each is linked with the next ones, not with the far ones
        rows.append((100 + i * 7 % 40, " ".join(chain)))
        chain = chain[3:] + prose(1000 + i, 3)
    for i in range(60):                                    # unlinked documents with a passage in common
        rows.append((200 + i, " ".join(common + prose(2000 + i, 30))))
    rows += [(300 + i, " ".join(prose(3) + [f"x{i}"])) for i in range(30)]      # a group of near copies
    rows += [(400 + i, " ".join(prose(4))) for i in range(5)] + [(500, ""), (501, "one two"), (502, "one two")]
    assert found(spark, rows)[0] == brute(rows)


def test_few_jobs_when_a_turn_finds_nothing(spark):
    """Each job leaves its plan, its threads and its broadcasts in the driver until they are cleaned."""
    common = prose(1, 25)
    rows = [(i, " ".join(common + prose(10 + i, 30))) for i in range(12)] + [(50, " ".join(prose(10, 60))), (51, " ".join(prose(10, 60)))]
    rows += [(60 + i, " ".join(prose(7, 60) + [f"x{i}"])) for i in range(4)]
    out, n = found(spark, rows)
    assert out == brute(rows)
    assert n < 95, n  # 122 with a walk and a regrouping after turns without a link, 66 without
