"""The pipeline against a plain version of each stage, and odd tables."""
import pytest

import corpus_pipeline as CP
from tests.llm.test_simhash import _brute as simhash_brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Clean and junk documents, copies and near copies, shared lines, nulls and repeated rows."""
    import random
    rnd = random.Random(21)
    syll = ["an", "the", "ti", "on", "er", "ing", "ed", "ou", "ha", "st"]
    word = lambda: "".join(rnd.choices(syll, k=rnd.choice([1, 2, 3, 4])))
    line = lambda: " ".join(word() for _ in range(25)).capitalize() + "."
    shared = line()
    rows = []
    for i in range(80):
        lines = [line() for _ in range(rnd.randint(1, 5))] + ([shared] if i % 4 == 0 else [])
        rows.append([i, "\n".join(lines), "en"])
    rows += [[100 + i, rows[i][1], "en"] for i in range(5)]
    near = rows[10][1].split(" ")
    near[3] = "other"
    rows += [[120, " ".join(near), "en"]]
    rows += [[200 + i, "!! ".join(word().upper() for _ in range(80)), "en"] for i in range(12)]
    rows += [[300, None, "en"], [301, "", None], [None, line(), "en"], [7, rows[7][1], "en"], [302, shared, "xx"]]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*r, "src", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(200, 0, 0), (201, 0, 0), (61, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def _rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_each_stage_works_on_all_its_predecessor_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n = docs.count()

    good = CP.quality(spark, docs, sf_dir).cache()
    kept = {r["doc_id"] for r in good.collect()}
    assert good.columns == COLUMNS and not kept & set(range(200, 212)) and n - good.count() <= 14
    assert {300, 301, 302, None} <= kept

    lines = CP.line_dedup(spark, good, sf_dir).cache()
    before, after = _rows(good), _rows(lines)
    assert lines.columns == COLUMNS and len(before) == len(after)
    seen, want = [], []
    for d, text, lang, source, _ in sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0)):
        left = []
        for x in (text.split("\n") if text is not None else []):
            s = set(x.split())
            if s and any(len(s & o) >= 0.8 * len(s | o) for o in seen):
                continue
            left.append(x)
            if s:
                seen.append(s)
        want.append((d, None if text is None else "\n".join(left), lang, source, None if text is None else len("\n".join(left))))
    assert sorted(set(after), key=str) == sorted(set(want), key=str)

    single = CP.near_dedup(spark, lines, sf_dir).cache()
    found = simhash_brute([(r[0], r[1]) for r in after])
    keep = {d for d, _, component in found if d is not None and d == component}
    assert single.columns == COLUMNS and sorted(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == sorted(keep)

    packed = CP.packing(spark, single, sf_dir)
    assert _rows(packed) == _rows(single)
    assert packed.filter("batch_id IS NULL OR bucket_tokens < n_tokens").count() == 0
    assert sorted(r["doc_id"] or -1 for r in CP.run(spark, sf_dir).collect()) == sorted(r["doc_id"] or -1 for r in packed.collect())


def test_empty_tables(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert CP.run(spark, str(tmp_path)).count() == 0


def test_stages_are_listed_in_order():
    assert [name for name, _ in CP.STAGES] == ["quality", "line_dedup", "near_dedup", "packing"]
    assert CP.ORACLE_SQL is None
