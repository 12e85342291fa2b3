"""The ten operators against brute force, on small fixtures with nulls, ties, repeats, long texts and no rows."""

import hashlib
import io
import os
import random
import re
import struct
import zlib

import numpy as np
import pytest

from sluice.llm import ann, common, exact_dedup, line_dedup, packing, pieces, quality, secret_scan, shingle_sets, simhash, sstable, suffix_dedup, tokens, trigrams

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def texts():
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "s", "en"]) for _ in range(n))
    base, passage = line(60), line(15)
    out = [
        (1, base), (2, base.replace(" ", "\n", 3)), (3, base), (4, line(40) + " " + passage + " " + line(20)), (5, passage),
        (6, ""), (7, None), (8, "  \t "), (9, line(3000)), (10, base[:-9] + "changed"), (11, passage + "\n" + line(30)), (12, "Token = abcdefgh9"),
        (12, "Token = abcdefgh9"), (None, base), (13, "é" * 70), (14, "x" + "é" * 70), (15, "a▁b  c "),
    ]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the operators use inside
    rows = [(d, t, "k", 1, "h") for d, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, fp int, digest string")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def normal(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, tmp_path, weak):
    docs.write.parquet(f"{tmp_path}/d")
    digest = (lambda c: c.substr(1, 1)) if weak else exact_dedup.sha256  # texts that differ share a digest
    got = exact_dedup.exact_dedup(spark, f"{tmp_path}/d", digest=digest, rows_per_salt=2, files_per_trigger=1).collect()
    groups = {}
    for d, t in texts():
        groups.setdefault(normal(t), []).append(d)
    assert len(got) == len(texts())
    want = sorted((str(d), str(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in texts())
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    one, two = [(5, "a b"), (6, "other")], [(3, "a  b"), (9, "a b"), (10, "new")]
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/d")
        got = exact_dedup.exact_dedup(spark, f"{tmp_path}/d", state_dir=f"{tmp_path}/state").collect()
        keep = {5: 5, 6: 6} if k == 0 else {5: 3, 6: 6, 3: 3, 9: 3, 10: 10}
        assert {r.doc_id: r.keep_id for r in got} == keep
    assert {r.group_size for r in got if r.keep_id == 3} == {3}


def test_exact_dedup_of_nothing(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/d")
    assert exact_dedup.exact_dedup(spark, f"{tmp_path}/d").count() == 0


def test_merge_dropout(docs, none):
    path = tokens.vocabulary("piece_bpe_32k.model")
    plain, noisy = pieces.Pieces(path, 0.0), pieces.Pieces(path, 0.3)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for d, t in texts():
        if "▁" not in (t or ""):
            assert list(np.frombuffer(plain.encode(t), "<u4")) == model.encode(t or "")
        assert noisy.decode(noisy.encode(t, d)) == (t or "")
    assert noisy.encode(texts()[8][1], 1) != plain.encode(texts()[8][1], 1)
    units = sorted({u for _, t in texts() for u in re.findall(" *[^ ]+| +", " " + (t or ""))})
    assert noisy._segment_many(units, 2) == [struct.pack(f"<{len(x)}I", *x) for x in (noisy._segment(u, 2) for u in units)]
    coded = pieces.encode(docs, path)
    back = pieces.decode(coded, path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(d), t or "") for d, t in texts())
    assert pieces.encode(none, path).count() == 0


def test_merge_dropout_draws_for_each_occurrence():
    noisy = pieces.Pieces(tokens.vocabulary("piece_bpe_32k.model"), 0.3)
    text = "international " * 60 + "☃x " + "international" * 2
    units = pieces._UNIT.findall(" " + text)
    keys = pieces._draws(pieces.SEED, np.full(len(units), 7), np.arange(len(units)))
    want = [struct.pack(f"<{len(x)}I", *x) for x in (noisy._segment(u, int(k)) for u, k in zip(units, keys))]
    assert len(set(want[:60])) > 4  # one word, one document
    assert noisy.encode(text, 7) == b"".join(want) and noisy.decode(noisy.encode(text, 7)) == text
    assert noisy.encode_batch(["international", text, text], [1, 7, 8])[1:] == [b"".join(want), noisy.encode(text, 8)]
    assert noisy.encode(text, 8) != noisy.encode(text, 7)


def test_merge_dropout_of_very_long_words():
    import time

    path, rng = tokens.vocabulary("piece_bpe_32k.model"), random.Random(3)
    noisy = pieces.Pieces(path, 0.3)
    long = "".join(rng.choice("aeinrst") for _ in range(60_000))
    began = time.perf_counter()
    ids = noisy.encode(f"x {long} y", 5)
    assert noisy.decode(ids) == f"x {long} y" and time.perf_counter() - began < 20
    unit = " " + long[:399]  # as long as words are that are segmented side by side
    keys = np.array([9], np.uint64)
    assert noisy._segment_many([unit], keys)[0] == struct.pack(f"<{len(noisy._segment(unit, 9))}I", *noisy._segment(unit, 9))


def line_frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def test_line_dedup_exact_and_fuzzy(spark, docs, none):
    rng = random.Random(5)
    long = " ".join(rng.choice(WORDS) + str(k) for k in range(90))
    rows = [
        (1, f"one line that repeats, in all!\n{long}\nshort\n--"), (2, "One line that repeats in all\n--\nshort\nanother line of its own here"),
        (3, long.replace("alpha", "alpha", 1) + "x"), (4, None), (5, ""), (None, "Short."), (6, "short\nshort"), (6, "short\nshort"),
    ]
    got = {(r.doc_id, k): r for k, r in enumerate(sorted(line_dedup.dedup_lines(line_frame(spark, rows)).collect(), key=lambda r: (r.doc_id or 99)))}
    by = {d: r for (d, _), r in got.items()}
    assert by[1].n_removed == 0 and by[1].line_text == rows[0][1] and by[1].n_lines == 4
    assert by[2].line_text == "--\nanother line of its own here" and by[2].n_removed == 2  # lines without a letter or digit stay
    assert by[3].n_removed == 1 and by[4].line_text is None and by[4].n_lines == 0 and by[5].line_text == ""
    assert by[None].n_removed == 1 and len(got) == len(rows) and by[6].n_removed == 2
    assert line_dedup.dedup_lines(none).count() == 0
    left = line_dedup.drop_repeated_lines(line_frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("1", rows[0][1]), ("2", by[2].line_text), ("4", None), ("5", "")], key=str)
    out = line_dedup.dedup_lines(docs)
    assert out.count() == len(texts()) and set(docs.columns) < set(out.columns)


def test_line_dedup_beside_columns_of_its_own_names(spark):
    names = ["gone", "d", "h", "row", "text", "lines", "removed", "Line_Text", "_gone", "a", "key"]
    rows = [(k, *(["one line that repeats"] * len(names))) for k in range(3)]
    table = line_frame(spark, rows, "doc_id long, " + ", ".join(f"`{n}` string" for n in names))
    out = line_dedup.dedup_lines(table)
    assert out.columns == ["doc_id", *[n for n in names if n != "Line_Text"], "line_text", "n_lines", "n_removed"]
    assert sorted((r.doc_id, r.n_removed, r.row, r.line_text) for r in out.collect()) == [(k, int(k > 0), "one line that repeats", "" if k else "one line that repeats") for k in range(3)]
    left = line_dedup.drop_repeated_lines(table).collect()
    assert [tuple(r) for r in left] == [rows[0]]


def edits(a, b):
    row = list(range(len(b) + 1))
    for x, c in enumerate(a, 1):
        new = [x]
        for y, d in enumerate(b, 1):
            new.append(min(row[y] + 1, new[-1] + 1, row[y - 1] + (c != d)))
        row = new
    return row[-1]


def alike(a, b):
    return edits(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)


def test_edit_similarity_is_in_characters_at_every_length(spark):
    rng = random.Random(9)
    words = [rng.choice(WORDS) for _ in range(30)]
    keyed = [" ".join([*words, "".join(rng.choice(k) for _ in range(150))]) for k in ("abcdefgh", "qrstuvwx")]  # one word of 31 differs
    long = [rng.choice(WORDS) + str(k) for k in range(90)]
    spelled = [w + "x" if k % 4 == 0 else w for k, w in enumerate(long)]  # a quarter of the words, few characters
    lines = [*keyed, " ".join(long), " ".join(spelled), " ".join(long[3:] + long[:3]), " ".join(reversed(long))]
    for _ in range(60):  # words taken out, put in, replaced, and letters changed
        w = [rng.choice(WORDS) for _ in range(rng.randint(1, 12))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(w))
            w[k : k + rng.randint(0, 2)] = [rng.choice(WORDS)] * rng.randint(0, 2) or w[k : k + 1]
        lines.append(" ".join(w) or "x")
    pairs = [(i, j, lines[i], lines[j]) for i in range(len(lines)) for j in range(i)]
    got = {(r.x, r.y) for r in line_dedup.edit_similar(spark.createDataFrame(pairs, "x int, y int, s string, t string"), 0.8).collect()}
    assert got == {(i, j) for i, j, s, t in pairs if alike(s, t)} and (3, 2) in got and (1, 0) not in got


def test_fingerprints_by_blocks(spark):
    import xxhash

    lines = [" ".join(f"word{k * k}" for k in range(n)) for n in (1, 2, 7, 30, 64, 300, 3000)] + ["the the the end"]
    for r in line_dedup.fingerprints(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "a long, norm string")).collect():
        blocks = [[] for _ in range(line_dedup.BLOCKS)]
        for w in set(lines[r.a].split(" ")):
            h = xxhash.xxh64_intdigest(w, 42)
            blocks[(h >> 50) % line_dedup.BLOCKS].append(h)
        fp, words = [0, 0, 0], 0
        for g, hs in enumerate(blocks):
            for lane in range(5):
                for j in range(3):
                    if 2 * sum(h >> 10 * lane + j & 1 for h in hs) > len(hs):
                        fp[g // 3] |= 1 << 10 * lane + 3 * (g % 3) + j
            words |= (1 << min(4, len(hs))) - 1 << 4 * g
        assert (r.f0, r.f1, r.f2, r.words) == (*fp, words)


def test_line_links_connect_what_all_pairs_do(spark):
    rng = random.Random(8)
    bases = [" ".join(rng.choice(WORDS) + rng.choice("abcdef") for _ in range(n)) for n in (8, 15, 40, 40)]
    lines = set(bases) | {" ".join(rng.choice(WORDS) for _ in range(5)) for _ in range(60)}
    for b in bases:
        for _ in range(25):
            w = b.split(" ")
            for _ in range(rng.randint(1, 2 if len(w) < 20 else 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines.add(" ".join(w))
    lines = sorted(lines)
    kinds = common.stage(spark.createDataFrame(list(enumerate(lines)), "a long, norm string"), "kinds")
    prints = common.stage(line_dedup.fingerprints(kinds), "prints")
    keyed, fps = {}, {r.a: (r.f0, r.f1, r.f2) for r in prints.collect()}
    for r in line_dedup.keys(prints).collect():
        keyed.setdefault(r.key, []).append(r.a)
    near = {(i, j) for v in keyed.values() for i in v for j in v if i < j and sum(bin(x ^ y).count("1") for x, y in zip(fps[i], fps[j])) <= line_dedup.BUDGET}
    ok = np.array([p for p in sorted(near) if alike(lines[p[0]], lines[p[1]])])
    label = simhash._roots(np.arange(len(lines)), ok[:, 0], ok[:, 1])
    want = {}
    for k in range(len(lines)):
        want.setdefault(int(label[k]), set()).add(k)
    found = {}
    for r in common.connected_components(line_dedup.line_links(kinds, prints)).collect():
        found.setdefault(r.root, set()).add(r.id)
    assert len(ok) > 300 and sorted(map(sorted, found.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_line_dedup_finds_lines_that_are_alike(spark):
    """Recall against edit similarity alone, for lines of 5 to 40 words."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 9)))
    vocabulary = [word() for _ in range(400)]
    pairs = []
    while len(pairs) < 240:
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 40))]
        v = list(w)
        for _ in range(rng.randint(1, max(1, len(w) // 8))):
            k, how = rng.randrange(len(v)), rng.random()
            v[k : k + 1] = [word()] if how < 0.5 else [] if how < 0.65 else [v[k], word()] if how < 0.8 else [v[k][:-1] + "z"]
        if v != w and alike(" ".join(w), " ".join(v)):
            pairs.append((" ".join(w), " ".join(v)))
    kinds = common.stage(spark.createDataFrame([(2 * k + i, x) for k, p in enumerate(pairs) for i, x in enumerate(p)], "a long, norm string"), "kinds")
    links = line_dedup.line_links(kinds, common.stage(line_dedup.fingerprints(kinds), "prints")).collect()
    found = {(r.src, r.dst) for r in links}
    short = [k for k, p in enumerate(pairs) if len(p[0]) <= 100]
    hit = [(2 * k, 2 * k + 1) in found for k in range(len(pairs))]
    assert sum(hit) >= 0.9 * len(hit) and sum(hit[k] for k in short) >= 0.85 * len(short) > 0


def test_lines_of_few_words_link_to_every_line_alike(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeilnors") for _ in range(rng.randint(1, 7)))
    lines = {"a", "ab", "la ja", "la ra", "all rights reserved", "all rights reservd", "heaon " * 90 + "and", "heaon " * 88 + "und", "x" * 700, "x" * 580 + "y" * 120, "漢字の行です" * 9, "漢字の行です" * 8 + "漢字"}
    for _ in range(60):
        base = " ".join(word() for _ in range(rng.randint(1, 8)))
        lines.add(base)
        for _ in range(3):
            new = list(base)
            for _ in range(rng.randint(1, 1 + len(new) // 5)):
                k = rng.randrange(len(new))
                new[k : k + 1] = rng.choice([[], [rng.choice("abc ")], [new[k], "e"]])
            lines.add(" ".join("".join(new).split()) or "z")
    lines = sorted(lines)
    want = {(i, j) for j in range(len(lines)) for i in range(j) if min(len(set(lines[k].split(" "))) for k in (i, j)) < line_dedup.FEW and abs(len(lines[i]) - len(lines[j])) <= 0.2 * max(len(lines[i]), len(lines[j])) and alike(lines[i], lines[j])}
    kinds = common.stage(spark.createDataFrame(list(enumerate(lines)), "a long, norm string"), "kinds")
    prints = common.stage(line_dedup.fingerprints(kinds), "prints")
    found = {(r.src, r.dst) for r in line_dedup.few_word_links(kinds, prints).collect()}
    assert len(want) > 60 and want <= found and all(alike(lines[i], lines[j]) for i, j in found)
    met = {r.id: r.root for r in common.connected_components(line_dedup.line_links(kinds, prints)).collect()}
    assert any(met.get(i, -1) != met.get(j, -2) for i, j in want)  # without them links are lost
    monkeypatch.setattr(line_dedup, "FEW_CHARS", 500)  # several broadcasts
    assert {(r.src, r.dst) for r in line_dedup.few_word_links(kinds, prints).collect()} == found
    docs = line_frame(spark, [(1, "all rights reserved"), (2, "all rights reservd"), (3, "something else")])
    assert {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(docs).collect()} == {1: 0, 2: 1, 3: 0}
    assert line_dedup.few_word_links(kinds.where("false"), prints.where("false")).count() == 0


def test_lines_that_share_word_pairs_link(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeilnors") for _ in range(rng.randint(2, 9)))
    often = [word() for _ in range(12)]
    lines = {"in erre to it rendon whrehe at of", "in erre to it therbl whrehe at of"}
    for _ in range(40):
        base = [rng.choice(often) if rng.random() < 0.4 else word() for _ in range(rng.choice([9, 30, 80]))]
        lines.add(" ".join(base))
        for _ in range(2):
            new = list(base)
            for k in sorted(rng.sample(range(len(new)), len(new) // 8), reverse=True):
                new[k : k + 1] = rng.choice([[word()], [], [new[k], word()]])
            lines.add(" ".join(new))
    lines = sorted(lines)

    def jaccard(s, t):
        a, b = (set(zip(w, w[1:])) for w in (s.split(" "), t.split(" ")))
        return len(a & b) / len(a | b)

    want = [(i, j) for j in range(len(lines)) for i in range(j) if jaccard(lines[i], lines[j]) >= line_dedup.PAIRED and alike(lines[i], lines[j])]
    kinds = common.stage(spark.createDataFrame(list(enumerate(lines)), "a long, norm string"), "kinds")
    before = common.stage(line_dedup.line_links(kinds, common.stage(line_dedup.fingerprints(kinds), "prints")), "links")
    parted = lambda links: {(i, j) for met in [{r.id: r.root for r in common.connected_components(links).collect()}] for i, j in want if met.get(i, -1) != met.get(j, -2)}
    assert len(want) > 40 and parted(before)  # without them links are lost
    none = before.where("false")
    for counted in (line_dedup.COUNTED_LINES, 1):  # at 1 many pairs are marked as frequent
        monkeypatch.setattr(line_dedup, "COUNTED_LINES", counted)
        for known in (before, none):
            links = line_dedup.word_pair_links(kinds, known)
            assert not parted(links) and all(alike(lines[r.src], lines[r.dst]) for r in links.collect())
    assert line_dedup.word_pair_links(kinds.where("false"), none).count() == 0
    a, b = min(parted(before))
    docs = line_frame(spark, [(1, lines[a]), (2, lines[b])])
    assert sorted(r.n_removed for r in line_dedup.dedup_lines(docs).collect()) == [0, 1]


def test_word_pairs_are_dealt_with_in_rounds(spark, monkeypatch):
    rng = random.Random(6)
    often = ["".join(rng.choice("abcdeilnors") for _ in range(rng.randint(3, 9))) for _ in range(60)]
    lines = []
    for _ in range(60):
        base = [rng.choice(often) for _ in range(30)]
        lines += [" ".join(base), " ".join(base[:7] + ["new"] + base[8:])]
    kinds = common.stage(spark.createDataFrame(list(enumerate(lines)), "a long, norm string"), "kinds")
    none, plain, written = spark.createDataFrame([], "src long, dst long"), common.stage, []

    def stage(df, label, keep=False):
        out = plain(df, label, keep)
        written.extend((label, out.count(), f.removeprefix("file://")) for f in out.inputFiles()[:1])
        return out

    monkeypatch.setattr(shingle_sets, "ROUNDS", 3, raising=False)
    monkeypatch.setattr(shingle_sets, "ROUND_KEYS", 100, raising=False)
    monkeypatch.setattr(common, "stage", stage)
    links = line_dedup.word_pair_links(kinds, none)
    keyed = [(n, f) for label, n, f in written if label in ("met", "members")]
    assert max(n for n, _ in keyed) < sum(n for n, _ in keyed) / 2  # no table has the rows of all keys
    assert not any(os.path.exists(f) for _, f in keyed)
    assert {(r.src, r.dst) for r in links.collect()} == {(k, k + 1) for k in range(0, len(lines), 2)}


def test_keys_of_fingerprints_are_dealt_with_in_rounds(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(d, " ".join(rng.choice(WORDS) for _ in range(9))) for d in range(40)], "a long, norm string")
    prints = common.stage(line_dedup.fingerprints(rows), "prints")
    parts = [line_dedup.keys(prints, k, 3).collect() for k in range(3)]
    assert all(parts) and sorted(sum(parts, [])) == sorted(line_dedup.keys(prints).collect())


def test_new_words_are_encoded_together():
    rng = random.Random(8)
    encoder = tokens.WordEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    plain, calls = encoder._tokenizer, []

    class Counting:
        model = type("Model", (), {"tokenize": staticmethod(lambda word: calls.append(word) or plain.model.tokenize(word))})

        def encode(self, text, **options):
            calls.append(text)
            return plain.encode(text, **options)

    encoder._tokenizer = Counting()
    text = " ".join("".join(rng.choice("abcdeéßñ漢") for _ in range(9)) for _ in range(2000))
    want = lambda x: struct.pack(f"<{len(ids := plain.encode(x, add_special_tokens=False).ids)}I", *ids)
    assert encoder.encode([text, None, text]) == [want(text), b"", want(text)]
    assert len(calls) <= 2000 / tokens.TOGETHER + 5
    small = tokens.WordEncoder(tokens.vocabulary("byte_bpe_50k.json"), 30)  # emptied again and again, with pieces that can't be cut at
    words = ["  a", "b\n", "\n", "", "x1", "'s", "été", "一", "ª", "\u0345"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "c", "dd"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    assert [small.encode([x])[0] for x in texts] == [want(x) for x in texts]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)] + [(300 + k, [1.0] * 8) for k in range(40)]
    rows += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (403, [1.0, None] + [1.0] * 6), (404, [1.0, 2.0])]
    table = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, list string")
    got = {}
    for r in ann.nearest(table, table.where("vec_id % 20 = 0"), list_rows=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    good = [(k, np.array(v, np.float32).astype(float)) for k, v in rows[:340]]
    hits = 0
    for q, v in good[::20]:
        want = sorted((float(np.sqrt(((x - v) ** 2).sum())), k) for k, x in good if k != q)[:10]
        mine = [k for _, k, _ in sorted(got[q])]
        hits += len({k for _, k in want} & set(mine))
        if q >= 300:
            assert mine == [k for _, k in want]
    assert hits >= 0.9 * 170 and set(got) == {q for q, _ in good[::20]}
    assert ann.nearest(table.where("false"), table.where("false")).count() == 0


def test_nearest_with_more_lists_than_a_fixed_number_of_probes(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(12_000, 32)).astype(np.float32)
    table = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    asked, got = table.where("vec_id % 200 = 0"), {}
    for r in ann.nearest(table, asked, list_rows=80).collect():  # over 150 lists
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, 12_000, 200):
        d = ((v.astype(float) - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert hits >= 0.95 * 600
    # a ratio of nothing reads one list of fewer rows than wanted, and must go on
    few = ann.nearest(table, asked, list_rows=5, probe_ratio=0.0).groupBy("query_id").count().collect()
    assert len(few) == 60 and all(r["count"] == 10 for r in few)


def test_secret_scan(spark, docs, none):
    rows = [
        (1, 'é PASSWORD: "hunter2hunter2" and token=abc, api_key = secret: abcdefgh'), (2, "AKIA" + "A1" * 8 + " AKIA12 " + "ab12" * 7), (3, None), (4, ""),
        (5, "apikey:'0123456789abcdef01234567'"), (6, "-----BEGIN RSA PRIVATE KEY-----"), (7, "passwordd=x token token"), (8, "toKEN\t= abcdefg"),
    ]
    rules = [("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)]
    got = {r.doc_id: [(s.start, s.ord, s.stop) for s in r.secret_spans if s.ord < 3] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        want = sorted((m.start(), k, m.end()) for k, (_, p, g, least) in enumerate(rules) for m in re.finditer(p, t or "") if len(m.group(g)) >= least)
        assert got[d] == want
    clean = secret_scan.redact(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in clean.collect()}[2].startswith("[access] AKIA12 [hex]")
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs).count() == len(texts())
    assert secret_scan.scan(none).count() == 0
    many = " ".join(f"é token=abc{k:06d} gh" + "p_" + "a" * 36 for k in range(5000))
    got = [(s.start, s.ord, s.stop) for s in secret_scan.scan(spark.createDataFrame([(1, many)], "doc_id long, text string")).first().secret_spans]
    more = [(0, rules[0][1]), (2, rules[2][1]), *((k, r.pattern) for k, r in enumerate(secret_scan.RULES) if not r.base)]
    assert got == sorted((m.start(), k, m.end()) for k, p in more for m in re.finditer(p, many) if k != 2 or len(m[0]) >= 24) and len(got) == 15_000


def test_trigram_queries_never_miss():
    assert trigrams.query_of("[0-9a-f]{24,}") == trigrams.ANY
    for pattern, hits in (("(abc|xyz)def?", ["ABCde", "xyzdef"]), ("foo.*bar", ["foo--bar"]), ("(?:ab){3}c", ["abababc"]), ("x?yz[ab]c", ["yzac", "xyzbc"])):
        for h in hits:
            assert any(all(t in h.lower() for t in term) for term in trigrams.query_of(pattern))
    assert trigrams.query_of("foo.*bar") == frozenset([frozenset(["foo", "bar"])])


def test_simhash_groups(docs, none):
    got = simhash.simhash_groups(docs, shingle=4).collect()
    fps = np.array([simhash.fingerprint(t, 4) for _, t in texts()], np.uint64)
    assert sorted(np.array([r.fp for r in got], np.int64).view(np.uint64).tolist()) == sorted(fps.tolist())
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    label = simhash._roots(np.arange(len(fps)), i[near], j[near])
    ids = [d for d, _ in texts()]
    want = sorted((str(d), str(min((ids[k] for k in range(len(ids)) if label[k] == x and ids[k] is not None), default=None))) for d, x in zip(ids, label))
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == want
    assert simhash.simhash_groups(none).count() == 0


def test_trie_splits_heavy_nodes(spark):
    rng = np.random.default_rng(4)
    fps = np.unique(np.array([int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), replace=False)) for b in rng.integers(0, 2**63, 6, dtype=np.uint64) for _ in range(40)], np.uint64))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count(fps[i] ^ fps[j]) <= 4
    label = simhash._roots(np.arange(len(fps)), i[near], j[near])
    want = sorted(n for n in np.bincount(label) if n > 1)
    for rows in (10, 100_000):
        found = {}
        for r in common.connected_components(simhash.links(df, node_rows=rows)).collect():
            found[r.root] = found.get(r.root, 0) + 1
        assert sorted(found.values()) == want


def test_tables_and_shards(spark, docs, none, tmp_path):
    out = io.BytesIO()
    writer = sstable.Writer(out, block_bytes=200)
    rows = [(None, b"")] + [(d, struct.pack("<I", d + 50) * (d % 7 + 1)) for d in range(-40, 400, 3)] + [(400, b"aaaa"), (400, b"bbbb")]
    for d, v in rows:
        writer.add(d, v)
    writer.close()
    with pytest.raises(ValueError):
        writer.add(5, b"")
    table = sstable.Table(io.BytesIO(out.getvalue()))
    assert list(table) == rows and table.docs == len(rows) and table.blocks > 5
    assert table.get(400) == [b"aaaa", b"bbbb"] and table.get(-40) == [rows[1][1]] and table.get(None) == [b""] and table.get(1000) == [] and table.get(3) == []
    assert sum(table.may_hold(d) for d in range(10_000, 12_000)) < 100
    damaged = bytearray(out.getvalue())
    damaged[3] ^= 1
    with pytest.raises(ValueError):
        list(sstable.Table(io.BytesIO(damaged)))
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = sstable.read_shards(spark, f"file://{tmp_path}/s", sstable.write_shards(docs, f"file://{tmp_path}/s", path, 2)).collect()
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(path)
    ids = lambda t: [*want.encode(t or "", add_special_tokens=False).ids, 2]
    assert sorted((str(r.doc_id), list(struct.unpack(f"<{len(r.ids) // 4}I", r.ids))) for r in got) == sorted((str(d), ids(t)) for d, t in texts())
    got.sort(key=lambda r: r.start)
    assert [r.doc_id is not None for r in got] == sorted(r.doc_id is not None for r in got)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids) // 4
    assert sstable.read_shards(spark, f"file://{tmp_path}/e", sstable.write_shards(none, f"file://{tmp_path}/e", path, 2)).count() == 0


def test_word_encoder_is_the_library():
    from tokenizers import Tokenizer

    path = tokens.vocabulary("byte_bpe_50k.json")
    e = tokens.WordEncoder(path, cache_words=50)
    hard = ["", " ", "  a", "a  b ", "a \n b", "it's  ok\n\n\nfoo <|endoftext|> bar", "a\tb c ", "é  è", " x y　z", "日本 語", " x", "12 34.5,!?  "]
    hard += ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|> ", "<|endoftext|", "x <|endoftext|>\n\n"] + [t for _, t in texts()]
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in hard], add_special_tokens=False)
    for _ in range(2):
        assert [list(np.frombuffer(x, "<u4")) for x in e.encode(hard)] == [list(x.ids) for x in want]


def brute_repeats(rows):
    """What is left by a dictionary of all windows."""
    rows = [(d if d is not None else 1 << 62, t) for d, t in rows]
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], 1 << 62))
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(b)))
        want.append((str(d if d < 1 << 62 else None), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return want


def test_suffix_dedup(docs, none):
    got = suffix_dedup.remove_repeats(docs.repartition(5)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(texts()))
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_prefix_groups_and_windows():
    rng = random.Random(1)
    part = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    shared = part(60)
    parts = [part(20)[:12] + shared, shared[:70] + part(8), part(66), shared[5:58]]
    least = np.array([5, 3, 1, 9])
    hits = {(int(k), w) for k, x, y in zip(*suffix_dedup.shared_windows(parts, least)) for w in range(x, y - 49)}
    for k, p in enumerate(parts):
        for at in range(len(p) - 49):
            assert ((k, at) in hits) == any(p[at : at + 50] in q for j, q in enumerate(parts) if least[j] < least[k])


@pytest.mark.parametrize("small", [False, True])
def test_suffix_dedup_of_copies_and_phrases(spark, monkeypatch, small):
    """Several packs and buckets, a text larger than a pack, copies, near copies, one phrase in many texts."""
    rng = random.Random(12)
    line = lambda n: " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n))
    base, long, phrase, near = line(120), line(3000), "all rights reserved by nobody at all, 123", line(150)
    rows = [(k, base) for k in range(0, 60, 3)] + [(100, long), (101, long[4000:9000]), (102, line(5) + long[:12_000])]
    rows += [(200 + k, line(3) + phrase + line(3)) for k in range(40)]
    for k in range(30):
        w = near.split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append((300 + k, " ".join(w)))
    rng.shuffle(rows)
    if not small:
        got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))
        return
    # many packs, buckets, groups and transforms, in this process
    import pyarrow as pa
    import pyspark

    for name, value in (("PACK_BYTES", 4000), ("BATCH_BYTES", 600), ("HOT_SEGMENTS", 3), ("PACKS_A_GROUP", 2), ("_SLICE", 500)):
        monkeypatch.setattr(suffix_dedup, name, value)
    monkeypatch.setattr(pyspark.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 1})()))
    buckets, groups = 5, 7
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    packs = [pa.Table.from_batches([x]) for x in suffix_dedup._packer([batch])]

    def by(tables, key):
        whole = pa.concat_tables(tables)
        return {k: whole.filter(pa.compute.equal(whole[key], k)).combine_chunks() for k in whole[key].unique().to_pylist()}

    sent = by([pa.Table.from_batches(suffix_dedup._send(buckets)(p.to_batches())) for p in packs], "bucket")
    replies = by([suffix_dedup._judge(t) for t in sent.values()], "pack")
    assert len(packs) > 10 and len(sent) == buckets and any(suffix_dedup._HOT in r["flags"] for t in replies.values() for r in t.to_pylist())
    told = {p["pack"][0].as_py(): replies.get(p["pack"][0].as_py(), next(iter(replies.values())).slice(0, 0)) for p in packs}
    bytes_ = by([suffix_dedup._bring(buckets, groups)(p, told[p["pack"][0].as_py()]) for p in packs], "bucket")
    gone = by([suffix_dedup._compare(t) for t in bytes_.values()], "pack")
    empty = next(iter(gone.values())).slice(0, 0)
    got = [r for p in packs for r in suffix_dedup._apply(False)(p, gone.get(p["pack"][0].as_py(), empty)).to_pylist()]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(brute_repeats(rows))


def test_packing(docs, none):
    path = tokens.vocabulary("byte_bpe_50k.json")
    e = tokens.encoder(path)
    whole = sorted((str(d), e.encode([t])[0] + struct.pack("<I", 0)) for d, t in texts())
    got = packing.pack(docs.repartition(7), path, 0, window=64, open_windows=3, fan_in=2).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault((str(r.doc_id), r.doc_tokens), []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces_ in by_seq.values():
        at = 0
        for r in sorted(pieces_, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert sum(r.length for r in got) == sum(len(x) // 4 for _, x in whole)
    for d, ids in whole:
        mine = sorted(by_doc[d, len(ids) // 4], key=lambda r: r.start)
        if d == "12":  # two equal rows, packed each by itself
            assert sorted((r.start, r.length, r.ids_crc32) for r in mine) == sorted((r.start, r.length, zlib.crc32(ids[4 * r.start : 4 * (r.start + r.length)])) for r in mine)
            continue
        at = 0
        for r in mine:
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(ids[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(ids) // 4
    used, room = sum(r.length for r in got), 64 * len(by_seq)
    assert used / room > 0.9
    assert packing.pack(none, path, 0).count() == 0


def test_packer_holds_few_windows():
    packer = packing.Packer(window=10, open_windows=2, max_waste=1)
    out = [w for d, n in enumerate([7, 6, 5, 13, 4, 3]) for w in packer.add(d, b"\0\0\0\0" * n)]
    assert len(packer.rest()) <= 2
    assert sum(len(p[3]) for w in [*out, *packer.rest()] for p in w) == 4 * 38


def test_quality(spark, docs, none):
    rng = random.Random(2)
    good = [" ".join(rng.choice(WORDS) for _ in range(30)) for _ in range(150)]
    bad = [" ".join(rng.choice(["$$", "!!x", "zzz"]) + rng.choice("abc") for _ in range(30)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    held = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sum((got[k] >= 0.7) == (k < 150) for k in held) / len(held) > 0.95
    assert {r.doc_id for r in table.where(quality.held_out(table.doc_id)).collect()} == set(held)
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(labels.doc_id), 1 - labels.quality).otherwise(labels.quality))
    assert {r.doc_id: r.score for r in quality.score(table, quality.fit(table, flipped)).collect()} == got  # held-out labels teach nothing
    scores = quality.score(docs, model).collect()
    assert len(scores) == len(texts()) and all(0 <= r.score <= 1 for r in scores)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert quality.score(none, model).count() == 0 and quality.keep_good(none, model).count() == 0
    twice = table.unionByName(table.withColumn("text", quality.F.lit("other")))  # ids that repeat
    assert quality.fit(twice, labels, most=50) is not None
    order = ["a b a a", "", "x", "b b b b c b"]
    ids, share = quality.bag(order[3])
    got_ = dict(zip(ids.tolist(), (share * 1000).tolist()))
    near = [got_[int(b)] for b in quality.recency_buckets()[:3]]
    assert np.allclose(np.array(near) / near[2], [2, 3, 1])  # b, c are new; three times one word back, once two
    scorer = quality.Scorer(*model.weights())
    weights, bias = model.weights()
    by_bag = [1 / (1 + np.exp(-(bias + float(weights[i] @ s)))) for i, s in map(quality.bag, order)]
    assert np.allclose(scorer.scores(order), by_bag, atol=1e-6)
    only = quality.train([quality.bag("a b")], [1])
    assert quality.Scorer(*only.weights()).scores(["", None])[1] > 0.7


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (102, 101), (7, 7), (None, 3)]
    got = common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.id: r.root for r in got} == {**{k: 0 for k in range(31)}, 100: 100, 101: 100, 102: 100}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_suffix_dedup_reads_many_small_messages():
    import time

    import pyarrow as pa
    import zstandard

    text, n = "0123456789" * 600, 6000
    ids, lens = np.array([7], np.int64), np.array([len(text)], np.int64)
    pack = pa.Table.from_pylist([{"pack": 1, "ids": ids.tobytes(), "nulls": b"\0", "lens": lens.tobytes(), "text": zstandard.compress(text.encode()), "size": len(text)}])
    gone = [pa.table({"bucket": [k], "pack": [1], "start": [np.array([k]).tobytes()], "stop": [np.array([k + 1]).tobytes()]}) for k in range(0, n, 2)]
    began = time.perf_counter()
    got = suffix_dedup._apply(False)(pack, pa.concat_tables(gone * 4)).to_pylist()  # each in a batch of its own
    assert [(r["doc_id"], r["n_removed"], r["n_spans"]) for r in got] == [(7, n // 2, n // 2)] and time.perf_counter() - began < 5


def test_redaction_cuts_blocks_and_groups(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(secret_scan, "_BLOCK", 8)
    monkeypatch.setattr(secret_scan, "_GROUP", 2)
    bits = ["token=abcdef0123456789abcdef0123", "AKIA" + "Z" * 16, "0123456789abcdef" * 2, "ñadé ☃", " ", "x", "password: deadbeefdeadbeefdeadbeefdead"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(k))) for k in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.secret_spans for r in secret_scan.scan(frame).collect()}
    want = []
    for d, t in rows:
        out, at = "", 0
        for s in spans[d]:
            if s.start >= at:
                out += t[at : s.start] + f"[{secret_scan.RULES[s.ord].kind}]"
            at = max(at, s.stop)
        want.append((d, out + t[at:]))
    assert sorted(tuple(r) for r in secret_scan.redact(frame).collect()) == want and sum(map(len, spans.values())) > 100


def test_redaction_of_a_text_with_many_secrets(spark):
    import time

    n = 32_000
    frame = spark.createDataFrame([(1, " ".join(f"deadbeefdeadbeefdeadbeef{i:06x}" for i in range(n)))], "doc_id long, text string")
    began = time.perf_counter()
    assert secret_scan.redact(frame).first().text == " ".join(["[hex]"] * n) and time.perf_counter() - began < 40


def test_suffix_dedup_of_strings_that_a_document_has_twice(spark):
    """A document loses an earlier one's string wherever it has it, if its segments hold more than the string, too."""
    rng = random.Random(7)
    part = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    shared, end = part(50), part(30)
    twice = shared + end
    rows = [(1, shared + part(30)), (5, part(40) + twice + part(90) + twice + part(20) + twice), (9, twice + part(60) + twice), (9, part(5) + twice), (12, "a" * 70 + "b" + "a" * 70), (11, "ca" + "a" * 55)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id: r.n_removed for r in got}[5] == 150
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(brute_repeats(rows))


def test_long_lines_of_few_words_are_sorted_out_by_counts(spark, monkeypatch):
    """Lines over MARKED characters that differ too much by counts of late characters never reach the distance; no link goes for that."""
    rows = [(1, "ha 😀ho " * 40 + "x"), (2, "ha 😀ho " * 38 + "ha 😀ju " * 2 + "x"), (3, "pulu 😀dh " * 32 + "x"), (4, "ab"), (5, "abc")]
    kinds = spark.createDataFrame(rows, "a long, norm string")
    prints = line_dedup.fingerprints(kinds)
    want = {(1, 2)}
    assert {tuple(r) for r in line_dedup.few_word_links(kinds, prints).collect()} == want
    seen = []
    monkeypatch.setattr(line_dedup.F, "expr", lambda text, f=line_dedup.F.expr: seen.append(text) or f(text))
    line_dedup.few_word_links(kinds, prints)
    assert any("levenshtein" in t and all(f"'{c}'" in t for c in line_dedup.COUNTED_LATE) for t in seen)


def test_tables_are_written_by_methods_that_are_compiled(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "settings", lambda s, f=common.settings, **conf: seen.append(conf) or f(s, **conf))
    with common.workspace(spark):
        assert common.stage(spark.range(3), "t").count() == 3
    assert int(seen[0]["spark__sql__codegen__hugeMethodLimit"]) <= 8000
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "65535"
