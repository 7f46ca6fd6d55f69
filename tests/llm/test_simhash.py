import random

import xxhash
from pyspark.sql import functions as F

from bookspark.llm import simhash as S


def _brute_fp(text, width=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _brute(rows, max_bits=3):
    fps = [_brute_fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= max_bits:
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def _rows(seed=1, n=120):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éa", "THE", "The"]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.5:
            base = rnd.choice(rows)[1].split(" ")
            for _ in range(rnd.choice([0, 1, 1, 2])):
                base[rnd.randrange(len(base))] = rnd.choice(words)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 60, 200])))))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (903, "a b"), (904, "A  b"), (904, "A  b"), (None, "a b"),
                   (None, "zz qq vv xx"), (905, "x y " * 40000)]


def _key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)


def test_matches_brute_force_with_nulls_empty_and_repeated_rows(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_fp", F.lit(1)).withColumn("component_id", F.lit("x"))
    got = sorted((tuple(r) for r in S.near_duplicates(df).collect()), key=_key)
    assert got == sorted(_brute(rows), key=_key)


def test_large_cells_are_cut_without_losing_links(spark):
    rnd = random.Random(3)
    fps = {0}
    while len(fps) < 400:
        fps.add(rnd.choice(sorted(fps)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    fps |= {rnd.getrandbits(64) for _ in range(200)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    df = spark.createDataFrame(signed, "_fp long")
    want = None
    for rows in (4096, 16):
        found = {r["_node"]: r["_label"] for r in S.components(S.links(df, 3, cell_rows=rows)).collect()}
        groups = sorted(sorted(k for k in found if found[k] == lab) for lab in set(found.values()))
        label = {f: f for (f,) in signed}
        changed = True
        while changed and want is None:
            changed = False
            for a in label:
                for b in label:
                    if label[b] < label[a] and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
                        label[a], changed = label[b], True
        if want is None:
            by = {}
            for f, lab in label.items():
                by.setdefault(lab, []).append(f)
            want = sorted(sorted(v) for v in by.values() if len(v) > 1)
        assert groups == want


def test_empty_table_and_dedup(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, extra string")
    assert S.near_duplicates(empty).count() == 0 and S.dedup(empty).count() == 0
    rows = [(5, "a b c d e", "p"), (2, "A b c d e", "q"), (2, "A b c d e", "r"), (9, "other words are here", None), (None, "a b c d e", "s")]
    kept = S.dedup(spark.createDataFrame(rows, empty.schema)).collect()
    assert sorted(r["doc_id"] for r in kept) == [2, 9] and kept[0].asDict().keys() == {"doc_id", "text", "extra"}
