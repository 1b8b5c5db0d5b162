from pyspark.sql import functions as F

from attestlake.operators import folds


def test_size_bounded_chunks(spark):
    rows = [
        (1, [("a", "x" * 5), ("a", "y" * 5), ("a", " "), ("a", "z" * 5), ("b", "w")]),
        (2, [(None, "q" * 40), (None, "r"), (None, None)]),
        (3, []),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "id int, blocks array<struct<mark:string,text:string>>")
    got = {r.id: r.c for r in df.select("id", folds.size_bounded("blocks", 12).alias("c")).collect()}
    assert got == {1: ["xxxxx\n\nyyyyy", "zzzzz", "w"], 2: ["q" * 40, "r"], 3: [], 4: None}


def test_marker_run(spark):
    df = spark.createDataFrame([(1, list("abxc")), (2, list("bcd")), (3, []), (4, list("aab"))], "id int, m array<string>")
    assert [r.n for r in df.orderBy("id").select(folds.marker_run("m").alias("n")).collect()] == [3, 0, 0, 2]


def test_diverse_topk_against_greedy(spark):
    rows = [(k % 3, f"{'red blue green'.split()[k % 3]} {'box bag'.split()[k % 2]} {'of with'.split()[k // 5 % 2]} {k // 4}", float(k * 7 % 11)) for k in range(40)]
    got = {}
    for r in folds.diverse(spark.createDataFrame([*rows, (0, None, 99.0)], "g int, label string, score double"), "g", "label", "score", 4).collect():
        got.setdefault(r.g, {})[r.rank] = r.label
    for g in range(3):
        best = {}
        for k, label, s in rows:
            if k == g:
                best[label] = max(s, best.get(label, s))
        taken = []
        for label in sorted(best, key=lambda x: (-best[x], x)):
            w = set(label.split())
            if len(taken) < 4 and all(len(w & set(x.split())) / len(w | set(x.split())) < 0.6 for x in taken):
                taken.append(label)
        assert [got[g][i + 1] for i in range(len(got[g]))] == taken


def test_chunks_keep_all_text(spark):
    text = F.lit("\n".join(f"line {i}" for i in range(500)))
    blocks = F.transform(F.split(text, "\n"), lambda x: F.struct(F.lit(None).cast("string").alias("mark"), x.alias("text")))
    chunks = spark.range(1).select(folds.size_bounded(blocks, 1200).alias("c")).first().c
    assert "\n\n".join(chunks).split("\n\n") == [f"line {i}" for i in range(500)] and max(map(len, chunks)) <= 1200
