import corpus_pipeline
from cloudgauge.llm import langid, mixing, packing, simhash, toxicity
from cloudgauge.llm.common import read_table

D = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = read_table(spark, D, "documents").cache()
    columns = docs.columns
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "toxicity", "near_duplicates", "mixing", "packing"]

    kept = stages["language"](spark, docs, D).cache()
    assert kept.columns == columns and len(ids(kept)) >= 0.98 * docs.count()

    clean = stages["toxicity"](spark, kept, D).cache()
    rated = toxicity.rate_toxicity(kept, toxicity.learn(kept, read_table(spark, D, "labels")))
    assert ids(clean) == ids(rated.where(f"score < {toxicity.THRESHOLD}")) and clean.columns == columns

    single = stages["near_duplicates"](spark, clean, D).cache()
    texts = [r["text"] for r in single.collect()]
    assert len(set(texts)) == len(texts) and single.columns == columns
    assert set(r["text"] for r in clean.collect()) >= set(texts)

    mixed = stages["mixing"](spark, single, D).cache()
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(single).collect() if r["taken"]}
    assert {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == taken and mixed.columns == columns

    packed = stages["packing"](spark, mixed, D)
    total = sum(len(packing.encoder(*packing.tokenizer_paths())(r["text"])) + 1 for r in mixed.collect())
    assert packed.groupBy().sum("length").first()[0] == total
    assert langid.UNKNOWN == "und" and simhash.SHINGLE == 3


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 0


def odd(spark, docs):
    """documents with nulls, empty, repeated and very long texts, and columns of the names that stages use inside."""
    row = docs.first().asDict()
    text = row["text"] or "these are some plain words of a text"
    rows = [
        {"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None},
        {"doc_id": -1, "text": ""}, {"doc_id": -2, "text": " \n\t "}, {"doc_id": -3, "text": "12345 67890"},
        {"doc_id": None, "text": "the quick brown fox jumps over the lazy dog near the river", "source": None},
        {"doc_id": -4, "text": text * 300}, {"doc_id": -5, "text": text}, {"doc_id": -5, "text": text},
    ]
    more = spark.createDataFrame([row | r for r in rows], docs.schema)
    return docs.unionByName(more).selectExpr("*", "'mine' AS _lang", "7 AS _score", "doc_id AS _row", "8 AS _number", "9 AS _n", "text AS h", "1 AS size", "'x' AS fp", "2 AS threshold", "map('k', doc_id) AS `a.b`")


def test_stages_on_odd_tables(spark):
    docs = odd(spark, read_table(spark, D, "documents")).cache()
    docs.count()
    have = {tuple(map(str, r)) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, D)
        assert got.schema.names == docs.schema.names, name
        rows = [tuple(map(str, r)) for r in got.collect()]
        assert rows and have.issuperset(rows), name
        by_text = [r[docs.columns.index("text")] for r in rows]
        assert (name == "language") <= (not {"None", "", " \n\t ", "12345 67890"} & set(by_text))
        assert (name == "near_duplicates") <= (len(rows) == len(set(rows)))
        assert stage(spark, docs.limit(0), D).count() == 0, name
    packed = corpus_pipeline.pack(spark, docs, D)
    assert packed.where("start = 0").count() == docs.count() and corpus_pipeline.pack(spark, docs.limit(0), D).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    docs = read_table(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().decode().split()) for r in docs.orderBy("doc_id").collect()]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for _, w in rows]
    up = list(range(len(sets)))

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, x in enumerate(sets):
        for j in range(i):
            if min(len(x), len(sets[j])) >= 0.8 * max(len(x), len(sets[j])):
                both = len(x & sets[j])
                if both >= 0.8 * (len(x) + len(sets[j]) - both):
                    a, b = sorted((top(i), top(j)))
                    up[b] = a
    want = {rows[k][0] for k in range(len(rows)) if top(k) == k}
    got = [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, D).select("doc_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
