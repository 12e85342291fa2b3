"""Every registered query of the subpackage over its whole table, against brute force."""

import hashlib
import re
import struct
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from test_operators import alike, brute_repeats

from sluice.llm import tokens
from sluice.llm.catalog import QUERIES


@pytest.fixture(scope="module")
def rows(sf):
    return duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()


def run(name, spark, sf):
    out = QUERIES[name](spark, sf)
    return out.dtypes, out.collect()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op2(spark, sf, rows):
    types, got = run("op2_merge_dropout", spark, sf)
    assert types == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint"), ("decoded_sha256", "string"), ("lossless", "boolean")]
    assert sorted((r.doc_id, r.decoded_sha256) for r in got) == sorted((d, sha(t or "")) for d, t in rows) and all(r.lossless for r in got)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    plain = {d: len(model.encode(t or "")) for d, t in rows}
    long = [r for r in got if plain[r.doc_id] > 50]
    assert 1.02 < sum(r.n_tokens for r in long) / sum(plain[r.doc_id] for r in long) < 1.6  # a skipped merge leaves more pieces


def test_op3(spark, sf, rows):
    _, got = run("op3_line_dedup", spark, sf)

    def norm(x):
        return re.sub("[\x20\x09-\x0d]+", " ", re.sub("[.,;:!?\"']", "", x.lower())).strip(" ")

    lines = [(d, k, norm(x)) for d, t in sorted(rows) for k, x in enumerate((t or "").split("\n")) if any(c.isalnum() for c in x)]
    kinds = sorted({x for _, _, x in lines})
    grams = [{x[i : i + 3] for i in range(len(x) - 2)} for x in kinds]
    root = {x: x for x in kinds}
    near = []
    for i in range(len(kinds)):  # all pairs: lengths and trigrams that rule similarity out, then the distance
        for j in range(i):
            m = max(len(kinds[i]), len(kinds[j]))
            if m < 700 and abs(len(kinds[i]) - len(kinds[j])) <= 0.2 * m and len(grams[i] & grams[j]) >= 0.5 * max(len(grams[i]), len(grams[j])) and alike(kinds[i], kinds[j]):
                near.append((kinds[i], kinds[j]))
    for a, b in near:
        a, b = root[a], root[b]
        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    first = {}
    for d, k, x in lines:
        first.setdefault(root[x], (d, k))
    gone = {}
    exact, seen = {}, set()
    for d, k, x in lines:
        gone[d] = gone.get(d, 0) + (first[root[x]] != (d, k))
        exact[d] = exact.get(d, 0) + (x in seen)
        seen.add(x)
    assert {r.doc_id: r.n_lines for r in got} == {d: len(t.split("\n")) if t is not None else 0 for d, t in rows}
    mine = {r.doc_id: r.n_removed for r in got}
    assert all(mine[d] >= exact[d] for d in exact)  # equal lines always go
    total, most = sum(mine.values()), sum(gone.values())
    assert len(near) > 5 and total - sum(exact.values()) >= 0.8 * (most - sum(exact.values()))


def test_op4(spark, sf):
    types, got = run("op4_ann", spark, sf)
    assert types == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    ids, vectors = zip(*((i, np.array(v, float)) for i, v in duckdb.sql(f"select vec_id, embedding from '{sf}/embeddings.parquet'").fetchall() if v is not None and np.any(np.array(v, float))))
    all_, ids = np.stack(vectors), np.array(ids)
    mine, hits, asked = {}, 0, 0
    for r in got:
        mine.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(mine) == {int(i) for i in ids if i % 100 == 0}
    for q, found in mine.items():
        d = np.sqrt(((all_ - all_[ids == q][0]) ** 2).sum(1))
        order = [k for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, len(order) + 1)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, v, s in found)
        hits, asked = hits + len({v for _, v, _ in found} & {int(ids[k]) for k in order}), asked + len(order)
    assert hits >= 0.9 * asked > 0


def test_op5(spark, sf, rows):
    _, got = run("op5_secret_scan", spark, sf)
    kinds = [
        ("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
        ("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 0), ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0), ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ]
    want = []
    for d, t in rows:
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[g]) >= least)
        said = [f"{kinds[k][0]}:{a}:{b}" for a, k, b in spans]
        base = [x for x, (_, k, _) in zip(said, spans) if k < 3]
        want.append((d, *(sum(k == i for _, k, _ in spans) for i in range(3)), sha(",".join(base)), ",".join(said)))
    assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in got) == sorted(want)
    assert sum(w[1] + w[2] + w[3] for w in want) > 0


def test_op6(spark, sf, rows):
    _, got = run("op6_simhash", spark, sf)
    fps = []
    for _, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    ids, values = [d for d, _ in rows], np.array(fps, np.uint64)
    label = np.arange(len(ids))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 4)
    for _ in range(len(ids)):
        before = label.copy()
        np.minimum.at(label, i, label[j])
        if (label == before).all():
            break
    want = sorted((d, f"{f:016x}", min(ids[k] for k in np.flatnonzero(label == x))) for d, f, x in zip(ids, fps, label))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


@pytest.fixture(scope="module")
def encoded(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return {d: x.ids for (d, _), x in zip(rows, tokenizer.encode_batch([t or "" for _, t in rows], add_special_tokens=False))}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def test_op7(spark, sf, encoded):
    _, got = run("op7_sstable", spark, sf)
    want, at = [], 0
    for d in sorted(encoded):
        ids = [*encoded[d], 2]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want


def test_op8(spark, sf, rows):
    _, got = run("op8_suffix_dedup", spark, sf)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))
    assert sum(r.n_removed for r in got) > 0


def test_op9(spark, sf, encoded):
    _, got = run("op9_packing", spark, sf)
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(encoded)
    for d, pieces in by_doc.items():
        ids, at = [*encoded[d], 0], 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.02 * sum(r.length for r in got) + 1024


def test_op10(spark, sf, rows):
    types, got = run("op10_quality", spark, sf)
    assert types == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_op10_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    _, got = run("op10_quality", spark, sf)
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    held = [(label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    rate = lambda y: np.mean([p == y for x, p in held if x == y])
    assert len(held) > 500 and rate(0) >= 0.95 and rate(1) >= 0.98
