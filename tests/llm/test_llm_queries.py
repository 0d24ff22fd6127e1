import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]
from oracles import same_rows  # noqa: E402

from pagewright.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_oracle(name, spark, duck, sf_dir):
    same_rows(QUERIES[name], ORACLES[name], spark, duck, sf_dir)


def test_pipeline_stages_compose(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() <= before
        before = docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert before > 100
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.select("doc_id", "n_tokens", "decoded_sha256").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens", "decoded_sha256").collect()))


def test_pipeline_against_brute_force(spark, tmp_path, monkeypatch):
    """Whole rows of the pipeline over awkward documents: plain Python for all but the toxicity model, whose scores are given."""
    import hashlib
    import random
    import re

    from pyspark.sql import functions as F
    from test_operators import awkward, docs_of, prose, shingles
    from tokenizers import Tokenizer

    import corpus_pipeline
    from pagewright.llm import toxicity
    from pagewright.llm.vocabularies import vocabulary

    rng = random.Random(21)
    items = [(0, prose(rng, 30)), (1, "four words only here"), (2, None)]
    base = prose(rng, 90)
    rows = [(None if i is None else i, t, s) for i, t, s in awkward(rng) if i != 9]
    rows += [(20 + i, prose(rng, 25) + "\nShared footer line\n" + prose(rng, 8), f"s{i % 12}") for i in range(24)]
    rows += [(60, base, "a"), (61, base + " more", "b"), (62, base.replace(base.split()[7], "other"), "c"), (63, "insult " + base, "c")]
    rows += [(70, prose(rng, 300) + " " + items[0][1], "a"), (71, " ".join(items[0][1].split()[:16]) + " " + prose(rng, 40), "b"), (72, "say Four Words Only Here now", "b")]
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(toxicity, "train", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model, text="text", into="score": docs.withColumn(into, F.when(F.coalesce(F.col(text), F.lit("")).contains("insult"), 0.9).otherwise(0.1)))
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if "insult" not in (r[1] or "")]
    sites, first = {}, {}
    for i, t, s in sorted(kept, key=lambda r: (r[0] is not None, r[0] or 0)):
        for p, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                sites.setdefault(line, set()).update({s} - {None})
                first.setdefault(line, (i, p))
    gone = {line for line, s in sites.items() if len(s) >= 10}
    assert gone == {"Shared footer line"}
    kept = [(i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i, p))) for i, t, _ in kept]
    sets = {i: shingles(t) for i, t in kept if i is not None}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    kept = [(i, t) for i, t in kept if i is None or root[i] == i]
    leaked = {i for i, t in kept for _, q in items for a in [shingles(q)] if a and 100 * len(a & shingles(t)) >= 80 * len(a)}
    assert {70} <= leaked and 61 not in {i for i, _ in kept}
    kept = [(i, t) for i, t in kept if i is None or i not in leaked]
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i or -1, ids, len(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest(), "g"))
    got = [(r["doc_id"] or -1, list(r["_ids"]), r["_n_tokens"], r["_decoded_sha256"], r["gone"]) for r in found]
    assert sorted(got) == sorted(want)
