"""The pipeline: every stage on its own input, and the whole run against plain versions."""

import corpus_pipeline as pipeline
from shelfline.llm import language, line_dedup, pieces
from shelfline.llm.common import table
from test_decontaminate import plain as leaked
from test_line_dedup import plain as without_repeats
from test_near_dedup import plain_components


def test_run_equals_plain_stages(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, sf, "documents").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    # Line dedup is compared with all pairs on its own; what it keeps goes on here.
    known = language.keep_known(table(spark, sf, "documents"))
    texts = {r.doc_id: r.text for r in line_dedup.keep_first_lines(spark, known).collect()}
    want_lines = without_repeats([(d, t) for d, t in docs if d in texts])
    assert sum(texts[d] == want_lines[d] for d in texts) >= 0.97 * len(texts)
    groups = plain_components(list(texts.items()))
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    bad = {d for d, _ in leaked(list(texts.items()), items)}
    vocabulary = pieces.Vocabulary(pieces.MODEL)
    kept = {d: t for d, t in texts.items() if d not in bad}
    want = dict(zip(kept, pieces.encode_texts(list(kept.values()), pieces.Encoder(vocabulary))))
    got = pipeline.run(spark, sf).collect()
    assert {r.doc_id: r.token_ids for r in got} == want and len(got) == len(want)
    assert len(want) < len(docs) and bad


def test_stages_keep_the_columns_and_take_odd_rows(spark, sf):
    rows = [(1, None, None, "s", 0, 1), (2, "", "en", "s", 0, 2), (None, "the thing is here", "en", None, None, 3), (4, "the thing " * 30_000, "en", "s", 9, 4)]
    shape = "doc_id long, text string, lang string, source string, n_chars long, fp int"
    base = table(spark, sf, "documents")
    odd = spark.createDataFrame(rows, shape).unionByName(base.limit(30), allowMissingColumns=True)
    for name, stage in pipeline.STAGES:
        for docs in (odd, odd.limit(0)):
            result = stage(spark, docs, sf)
            assert result.count() <= docs.count()
            if name != pipeline.STAGES[-1][0]:
                assert result.columns == docs.columns and result.schema == docs.schema or [f.dataType for f in result.schema] == [f.dataType for f in docs.schema]
