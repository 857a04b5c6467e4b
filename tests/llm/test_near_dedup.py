import itertools
import random

from flowmill.llm import near_dedup as nd


def sets_of(text):
    w = [x for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, sets_of(t)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if i is not None and j is not None and a and b and 100 * len(a & b) >= 75 * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), str(root(i) if i is not None else None)) for i, s in sets)


def got(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in df.collect())


def test_groups_chains_and_edges(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows, texts = [], []
    for k in range(40):  # near copies of one text, some below the threshold of others
        t = base[:]
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(len(t))] = word()
        texts.append(" ".join(t))
    chain = base[:]
    for k in range(12):  # a chain whose ends are unlike
        chain = chain[6:] + [word() for _ in range(6)]
        texts.append(" ".join(chain))
    shared = [word() for _ in range(30)]
    texts += [" ".join(shared + [word() for _ in range(30)]) for _ in range(20)]  # a passage in common only
    texts += ["A b\tC d E", "a B c D e", "one two", "one  two", "One two three", "", None, "   \n", texts[0], texts[0].upper()]
    rnd.shuffle(texts)
    rows = [(i, t, 5) for i, t in enumerate(texts)]
    rows += [(None, texts[0], 5), (3, texts[3], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    assert got(nd.near_duplicates(docs)) == brute([(i, t) for i, t, _ in rows])


def test_near_copies_about_the_threshold(spark):
    """A large group of copies of one text with one to nine edits, most pairs of which are a little below the threshold."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(300):
        t = base[:]
        for _ in range(rnd.randrange(1, 10)):
            t[rnd.randrange(len(t))] = word()
        rows.append((i, " ".join(t)))
    rows.append((300, " ".join(base)))
    assert got(nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_one_row_stays_of_each_group(spark):
    t = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(2, t), (1, t + " x"), (1, t + " x"), (3, "other words here are these"), (4, None), (None, t)], "doc_id long, text string")
    kept = nd.keep_one(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "3", "4", "None"]
    assert kept[0].asDict().keys() == {"doc_id", "text"}


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_xor_of_sketches_estimates_the_difference(spark):
    from pyspark.sql import functions as F

    rows = [(1, " ".join(f"a{i}" for i in range(400))), (2, " ".join(f"a{i}" for i in range(20, 420))), (3, " ".join(f"b{i}" for i in range(400)))]
    s = nd.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    x = s.select(F.col("doc_id").alias("i"), F.col("sketch").alias("a")).crossJoin(s.select(F.col("doc_id").alias("j"), F.col("sketch").alias("b")))
    d = {(r.i, r.j): r.d for r in x.select("i", "j", nd.sketch_distance(F.col("a"), F.col("b")).alias("d")).collect()}
    assert d[1, 1] == 0 and d[1, 2] < nd.sketch_limit() < d[1, 3]
