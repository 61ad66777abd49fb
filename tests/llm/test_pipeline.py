import corpus_pipeline
from tallyfield.llm import plans
from tests.llm.cases import SF_DIR, documents
from tests.llm.test_jaccard import brute
from tests.llm.test_lines import brute as cut_lines

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_one_by_one(spark):
    """Each stage's decisions against those of its query or of brute force on the stage's input."""
    stage = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    good = {r.doc_id for r in plans.op6_quality_classifier(spark, SF_DIR).collect() if r.score >= 0.5}
    judged = corpus_pipeline.written(stage["quality classifier"](spark, docs, SF_DIR), "t")
    assert judged.columns == COLUMNS and {d for d, _ in rows_of(judged)} == good
    cut = corpus_pipeline.written(stage["line dedup"](spark, judged, SF_DIR), "t")
    before = rows_of(judged)
    assert rows_of(cut) == sorted((d, t) for (d, _), (_, _, t) in zip(before, cut_lines([t for _, t in before]), strict=True))
    thin = corpus_pipeline.written(stage["n-gram Jaccard join"](spark, cut, SF_DIR), "t")
    groups = {d: c for d, _, c in brute(rows_of(cut))}
    assert thin.columns == COLUMNS and sorted(groups[d] for d, _ in rows_of(thin)) == sorted(set(groups.values()))
    clean = corpus_pipeline.written(stage["benchmark decontamination"](spark, thin, SF_DIR), "t")
    assert clean.columns == COLUMNS and 0 < clean.count() < thin.count()
    out = stage["BPE encoding and decoding"](spark, clean, SF_DIR)
    assert sorted((r.doc_id, r.decoded) for r in out.collect()) == rows_of(clean)


def test_odd_tables(spark):
    odd = documents(spark, [(1, None), (None, ""), (2, "a b"), (2, "a b"), (None, None)])
    for docs in (odd, documents(spark, [])):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "t")
            assert docs.columns == COLUMNS
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == docs.count()


def test_clashing_names_stay(spark):
    """Extra columns named as the stages name theirs come out as they went in."""
    names = ["n", "row", "_row", "score", "features", "n_dropped", "n_lines", "component_id", "contaminated", "items", "_order", "_digest"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", *(f"concat('{n}', doc_id) AS `{n}`" for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), "t")
        assert docs.columns == COLUMNS + names
    rows = docs.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).count() == len(rows)
