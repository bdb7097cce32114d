"""The pipeline's stages on a small table, each against what its operator decides or brute force."""

import random
import re
from collections import Counter

import corpus_pipeline
from tests.llm.test_documents import _hits, _near, _texts


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    texts = _texts()
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    rows += [(1000 + k, " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randrange(50)) for _ in range(40)) + (" vile gross nasty" if k % 4 == 0 else ""), "en", "s", 9) for k in range(200)]
    rows += [rows[9], (None, texts[4], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1000 + k, int(k % 4 == 0)) for k in range(150)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = [(1, " ".join(texts[7].split()[10:60]))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    stage = dict(corpus_pipeline.STAGES)
    keep = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    clean = stage["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns
    assert {i for i, _ in keep(clean)} == {r[0] for r in rows if not (r[1] or "").endswith("vile gross nasty")}
    one = stage["near_duplicates"](spark, clean, str(tmp_path)).cache()
    near = _near(keep(clean))
    assert {i for i, _ in keep(one)} == {i for i, _, _, k in near if k} and one.columns == docs.columns
    assert max(Counter(i for i, _ in keep(one) if i is not None).values()) == 1
    pure = stage["decontamination"](spark, one, str(tmp_path)).cache()
    hits = _hits(keep(one), items)
    assert any(h[5] for h in hits) and Counter(i for i, _ in keep(pure)) == Counter(h[0] for h in hits if not h[5])
    safe = stage["surrogates"](spark, pure, str(tmp_path)).cache()
    assert safe.columns == docs.columns and safe.count() == pure.count()
    assert not any(re.search(r"555-7713|Kant", t or "") for _, t in keep(safe))
    packed = stage["packing"](spark, safe, str(tmp_path))
    assert Counter(r.doc_id for r in packed.collect() if r.piece == 0) == Counter(i for i, _ in keep(safe))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()
    for name, f in stage.items():
        none = f(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and (name == "packing" or none.columns == docs.columns)
    named = clean.limit(20).selectExpr("*", "'own' as is_toxic", "7 as p_toxic", "8 as p_else")
    out = stage["toxicity"](spark, named, str(tmp_path))
    assert out.columns == named.columns and {(r.is_toxic, r.p_toxic, r.p_else) for r in out.collect()} == {("own", 7, 8)}
