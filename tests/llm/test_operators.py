"""Every operator against brute force over a fixture of ordinary and odd rows, empty tables and clashing names."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

import public_tokenizers as P
from arborist.llm import bpe, class_lm, language_id, license_scan, media, near_dedup, packing, pii, quality_classifier, quality_rules
from arborist.llm.spark_io import held_out, pick

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ---- quality classifier

def test_rule_ensemble_learns_and_compiles(spark, docs):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(["ant", "bee", "cat", "dog", "elk"]) + str(rng.randint(0, 99)) for _ in range(40)), 1) for i in range(150)]
    bad = [(1000 + i, " ".join(["SPAM!!"] * rng.randint(20, 60)), 0) for i in range(60)]
    rows = spark.createDataFrame(good + bad, "doc_id bigint, text string, label int")
    e = quality_classifier.fit(rows, rows.select("doc_id", "label"))
    assert 0 < len(e.rules) < 60
    out = {r.doc_id: r for r in quality_classifier.classify(rows, e).collect()}
    assert all(out[i].score > 0.8 for i, _, _ in good) and all(out[i].score < 0.2 and out[i].predicted == 0 for i, _, _ in bad)
    # the compiled column equals the rules applied to the statistics
    x = quality_classifier.statistics(docs).toPandas()
    arrays = np.stack([x[c].to_numpy() for c in quality_classifier.STATISTICS])
    total = e.intercept + sum(w * quality_classifier._holds(r, arrays) for r, w in e.rules)
    want = sorted(np.round(1 / (1 + np.exp(-total)), 9))
    assert sorted(round(r.score, 9) for r in quality_classifier.classify(docs, e).collect()) == pytest.approx(want)


def test_rule_ensemble_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    assert {r.score for r in quality_classifier.classify(docs, quality_classifier.fit(docs, none)).collect()} == {0.5}
    assert quality_classifier.classify(empty, quality_classifier.fit(empty, none)).count() == 0
    one = spark.createDataFrame([(0, 1), (1, 1), (None, 0), (2, None)], "doc_id bigint, label int")
    assert {round(r.score, 6) for r in quality_classifier.classify(docs, quality_classifier.fit(docs, one)).collect()} == {0.99}


def naive_statistics(t):
    b, w = (t or "").encode(), SPACE_WORD.findall(fold(t or ""))
    n = len(w)
    # repeats are told apart by case, distinct words aren't
    plain = SPACE_WORD.findall(t or "")
    windows = collections.Counter(tuple(plain[k : k + 5]) for k in range(n - 4))
    cover = {k + j for k in range(n - 4) if windows[tuple(plain[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if SPACE_WORD.search(x)]
    some, size, count = max(n, 1), max(len(b), 1), lambda f: sum(map(f, b))
    return [
        math.log(1 + n), sum(len(x.encode()) for x in w) / some, len(set(w)) / some, max(collections.Counter(w).values(), default=0) / some, len(cover) / some, (len(lines) - len(set(lines))) / (b.count(b"\n") + 1),
        count(lambda c: 65 <= c <= 90) / size, count(lambda c: 48 <= c <= 57) / size, count(lambda c: c >= 128) / size,
        count(lambda c: c in b"#*$%&|<>") / some, count(lambda c: c in b"!?") / some, count(lambda c: c in b".,;:") / some, b.count(b"\n") / some, count(lambda c: c in b"@=+_/\\") / some,
    ]


def test_rule_ensemble_equals_brute_force(spark, clashing, fixture_rows, tmp_path):
    """Statistics from the texts alone, and the registered query's scores from the rules over them."""
    from arborist.llm import queries

    got = collections.Counter((str(r[0]), tuple(round(x, 9) for x in r[1:])) for r in quality_classifier.statistics(clashing).collect())
    assert got == collections.Counter((str(r[0]), tuple(round(x, 9) for x in naive_statistics(r[1]))) for r in fixture_rows)
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["ant", "bee", "cat"]) + str(rng.randint(0, 99)) for _ in range(40)) if i % 3 else "SPAM!! " * rng.randint(5, 40)) for i in range(200)]
    rows += [(300, None), (301, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i % 3 > 0), 0) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = {r.doc_id: r for r in queries.op1_rule_ensemble(spark, str(tmp_path)).collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    e = quality_classifier.fit(docs, spark.createDataFrame([(i, q) for i, q, _ in labels if not held(i)], "doc_id long, label int"))
    for i, t in rows:
        x = dict(zip(quality_classifier.STATISTICS, naive_statistics(t)))
        total = e.intercept + sum(w for rule, w in e.rules if all((x[c] >= v) == least for c, least, v in rule))
        assert out[i].score == pytest.approx(1 / (1 + math.exp(-total))) and out[i].held_out == held(i) and out[i].predicted == (out[i].score >= 0.3)
    assert all((out[i].score >= 0.5) == (i % 3 > 0) for i in range(200) if held(i))


# ---- media columns

def test_media_round_trip(spark, docs, empty, clashing, fixture_rows):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.media_columns(clashing).collect())
    want = collections.Counter()
    for i, t, *_ in fixture_rows:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    assert got == want
    assert media.media_columns(empty).count() == 0


def test_media_shards_are_tar_files_addressed_by_content(spark, docs, tmp_path):
    import tarfile

    index, folder = media.store(docs, f"file://{tmp_path}/shards")
    rows = index.collect()
    for shard in {r.shard for r in rows}:
        with tarfile.open(tmp_path / "shards" / shard) as t:
            names = [m.name for m in t]
            assert len(names) == len(set(names))
            for m in t:
                assert hashlib.sha256(t.extractfile(m).read()).hexdigest() + ".png" == m.name
    h = {r.digest: r for r in media.headers(index, folder).collect()}
    assert set(h) == {r.digest for r in rows} and all(r.width == 576 and r.bits == 8 and r.payload_bytes == r.width * r.height for r in h.values())
    with pytest.raises(ValueError):
        media.metadata(b"x" * 33)


# ---- packing

def check_pieces(pieces, texts, segments=packing.SEGMENTS):
    units = packing.encoder(P.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for i, t in texts:
        ids = np.array([*units.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids))] += len(ids)
    got = collections.Counter()
    for r in pieces:
        got[(r.doc_id, r.doc_tokens)] += r.length
    assert got == want
    padding, by = 0, collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append(r)
    for members in by.values():
        members.sort(key=lambda r: r.offset)
        at = 0
        for r in members:
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 2048 and len(members) <= segments
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    return units


def test_packing_documents(spark, docs, empty, clashing, fixture_rows):
    pieces = packing.pack_documents(clashing).collect()
    units = check_pieces(pieces, [r[:2] for r in fixture_rows])
    texts = {r[0]: r[1] for r in fixture_rows}
    for r in pieces:
        ids = np.array([*units.tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack_documents(empty).count() == 0


def test_packing_respects_segments(spark):
    rows = [(i, "x") for i in range(900)]
    check_pieces(packing.pack_documents(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1), segments=16).collect(), rows, 16)


def test_dot_product_heuristic_on_whole_examples(spark):
    rng = np.random.RandomState(3)
    rows = [(i, int(rng.randint(1, 900)), int(rng.randint(1, 4)), int(rng.randint(0, 400))) for i in range(200)] + [(900, 5000, 1, 1), (901, None, None, None)]
    ex = spark.createDataFrame(rows, "id bigint, tokens bigint, segments bigint, loss bigint")
    out = packing.pack_examples(ex.coalesce(1), 2048, 8, 1024).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    need, by = {r[0]: [x or 0 for x in r[1:]] for r in rows}, collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(need[r.id])
    for members in by.values():
        assert len(members) == 1 or (np.sum(members, 0) <= [2048, 8, 1024]).all()
    assert len(by) <= 1.25 * sum(n[0] for n in need.values()) / 2048 + 2
    # the choice is the fitting example with the largest dot product
    assert packing.choose(np.array([[10, 1, 1], [60, 1, 1], [200, 1, 1]], float), np.array([100.0, 5, 5]), np.array([100.0, 5, 5])) == 1


def test_packing_conversations(spark, tmp_path):
    from arborist.llm import queries

    rng = random.Random(6)
    rows = [(c, t, ("user", "assistant", "assistant", None)[t % 4], " ".join(rng.choice(["hello", "Zürich", "12", "..."]) for _ in range(rng.randint(0, 300)))) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(70, 0, "assistant", None), (None, 0, "user", "x"), (71, 0, "assistant", "word " * 3000), (72, 0, "user", "a"), (72, 0, "user", "a")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = queries.pack_conversations(spark, str(tmp_path)).collect()
    units = packing.encoder(P.path("byte_bpe_50k.json"))
    want = {}
    for c, _, role, text in rows:
        n = len(units.tokenizer.encode(text or "", add_special_tokens=False).ids) + 1
        d = want.setdefault(c, [0, 0, 0])
        d[0], d[1], d[2] = d[0] + n, d[1] + 1, d[2] + n * (role == "assistant")
    assert {r.id: [r.tokens, r.segments, r.loss] for r in out} == want and len(out) == len(want)
    by = collections.defaultdict(list)
    for r in out:
        by[r.sequence_id].append(want[r.id])
    sums = [np.sum(m, 0) for m in by.values() if len(m) > 1]
    assert all((s <= [2048, 16, 1024]).all() for s in sums)
    # the limit on loss decides where a sequence ends
    assert any(s[2] > 900 and s[0] < 1800 for s in sums)


# ---- near-duplicates

def bag(t):
    w = SPACE_WORD.findall(fold(t or ""))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def components(rows, least=0.8):
    bags = {i: bag(t) for i, t in rows}
    of = {i: i for i in bags}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a]:
                if sum((bags[a] & bags[b]).values()) >= least * sum((bags[a] | bags[b]).values()):
                    x, y = find(a), find(b)
                    of[max(x, y)] = min(x, y)
    return {i: find(i) for i in bags}


def test_near_duplicates_equal_brute_force(docs, empty, clashing, fixture_rows):
    rows = [r[:2] for r in fixture_rows if r[0] is not None]
    out = near_dedup.near_duplicates(clashing).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in fixture_rows)
    got = {r.doc_id: r.class_id for r in out if r.doc_id is not None}
    want = components(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)
    assert got == want and len({want[i] for i in (0, 100, 101, 102, 103)}) == 1 and len({want[i] for i in (1, *range(110, 115))}) == 1
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_duplicates_of_large_groups_and_shared_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = []
    for i in range(150):  # near copies of one text
        w = list(base)
        w[rng.randrange(120)] = word()
        rows.append((i, " ".join(w)))
    for i in range(200, 330):  # different texts that share a passage
        rows.append((i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(5)])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()} == components(rows)


def test_near_duplicates_of_variants_at_every_distance(spark, monkeypatch):
    """1,000 variants around one text, most of them below 0.8 of one another, in blocks of a few rows."""
    monkeypatch.setattr(near_dedup, "OUTSIDERS", 16)
    monkeypatch.setattr(near_dedup, "MEMBERS", 100)
    monkeypatch.setattr(near_dedup, "SHARE", 50)
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base, rows = [word() for _ in range(90)], []
    for i in range(1000):
        w = list(base)
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got, want = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(df).collect()}, components(rows)
    assert len(set(want.values())) > 3 and got == want


def test_near_duplicates_of_texts_that_share_an_id(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    a, b = ([word() for _ in range(80)] for _ in range(2))
    changed = [*a[:40], "other", *a[41:]]
    texts = [(1, a), (1, b), (2, changed), (3, [*b, "more"]), (None, b), (None, [word() for _ in range(9)]), (1, a), (4, None)]
    df = spark.createDataFrame([(i, t and " ".join(t)) for i, t in texts], "doc_id bigint, text string")
    got = sorted(map(str, ((r.doc_id, r.class_id, r.kept) for r in near_dedup.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False), (None, None, True), (4, 4, True)]))


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.RandomState(0)
    key = rng.randint(1, 2**62, 300).astype(np.uint64)
    a, b = rng.randint(1, 9, 300), rng.randint(1, 9, 300)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 300)
    sig = near_dedup.signatures(row, np.concatenate([key, key]), np.concatenate([a, b]), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4000)


# ---- language model

def test_class_lm_counts_and_probabilities(spark, docs, empty, clashing, fixture_rows):
    model, counts = class_lm.fit(clashing.where(~held_out(10, 0)))
    out = class_lm.score(clashing, model, counts).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: [*SPACE_WORD.findall(fold(t or "")), "\0"]
    c = collections.Counter(w for i, t, *_ in fixture_rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(words(t)), sum(c[w] > 0 for w in words(t)), round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), 6)) for i, t, *_ in fixture_rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want
    assert {r.train_tokens for r in out} == {n}
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    # probabilities of known words and unseen slots sum to 1 after any class
    assert model.follow.sum(1) == pytest.approx(np.ones(len(model.follow)))
    assert model.z == pytest.approx(n + 0.1 * (v + 1))
    assert class_lm.score(empty, *class_lm.fit(empty)).count() == 0
    assert all(math.isfinite(r.score) for r in class_lm.score(docs, *class_lm.fit(empty)).collect())


def test_class_lm_scores_equal_brute_force(spark, tmp_path, fixture_rows):
    """The registered query's scores, from the model's classes alone."""
    from arborist.llm import queries

    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([r[:2] for r in fixture_rows], "doc_id long, text string").repartition(4).write.parquet(at)
    model, _ = class_lm.fit(spark.read.parquet(at).where(~held_out(10, 0)))
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    words = lambda t: SPACE_WORD.findall(fold(t or ""))
    end = int(model.of[-1])

    def cls(w):
        b = np.frombuffer(w.encode(), np.uint8)
        h = class_lm.span_hashes(b, np.array([0]), np.array([len(b)]), True)
        tail = int(b[-1]) + (int(b[-2]) << 8 if len(b) > 1 else 0)
        return int(model.classes(h, np.array([tail]))[0])

    of = {w: cls(w) for _, t, *_ in fixture_rows for w in words(t)}
    k = end + 1
    pair, c = np.zeros((k, k)), collections.Counter()
    for i, t, *_ in fixture_rows:
        if not held(i):
            seq = [end, *(of[w] for w in words(t)), end]
            np.add.at(pair, (seq[:-1], seq[1:]), 1)
            c.update([*words(t), None])
    share = (pair.sum(0) + 0.5) / (pair.sum() + 0.5 * k)
    follow = (pair + 5 * share) / (pair.sum(1, keepdims=True) + 5)
    by = collections.defaultdict(list)
    for w, n in c.items():
        by[end if w is None else of[w]].append(n)
    n, v = sum(c.values()), len(c)
    z = n + 0.1 * (v + 1)

    def p(a, w):
        b = end if w is None else of[w]
        counts = by.get(b, [])
        n1, n2 = counts.count(1), counts.count(2)
        d = max(1e-3, min(0.95, n1 / max(n1 + 2 * n2, 1))) if counts else 0
        left = (sum(counts) if w is None else c[w] - d) if c[w] else (d * len(counts) if counts else 1e-3)
        left = c[None] - d if w is None else left
        return 0.95 * follow[a, b] * left / max(sum(counts), 1e-3) + 0.05 * (c[w] + 0.1) / z

    want = []
    for i, t, *_ in fixture_rows:
        seq = [None, *words(t), None]
        want.append((str(i), round(sum(math.log10(p(end if a is None else of[a], w)) for a, w in zip(seq, seq[1:])), 5)))
    got = sorted((str(r.doc_id), round(r.score, 5)) for r in queries.op5_brown_classes(spark, str(tmp_path)).collect())
    assert [g[0] for g in got] == [w[0] for w in sorted(want)] and [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], abs=2e-4)


def test_exchange_puts_alike_units_together():
    rng = np.random.RandomState(1)
    u, v = [], []
    for _ in range(4000):  # units 0-9 are followed by 10-19 and these by 0-9
        a, b = rng.randint(10), 10 + rng.randint(10)
        u += [a, b]
        v += [b, rng.randint(10)]
    key, n = np.unique(np.array(u) * 20 + np.array(v), return_counts=True)
    of = class_lm.exchange(20, key // 20, key % 20, n.astype(float), 2)
    assert len(set(of[:10])) == len(set(of[10:])) == 1 and of[0] != of[10]


# ---- personal data

def naive_spans(t):
    out = []
    for k, p in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, all(int(x) <= 255 for x in m[0].split(".")) if k == 1 else 0, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_patterns_equal_plain_regexes():
    rng = random.Random(4)
    for _ in range(4000):
        t = "".join(rng.choice("ab.@@-+% 1(2)34.5\n9é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == naive_spans(t), t
    assert len(pii.base_spans("0" * 5000 + ".1.1.1")) == 1


def test_pii_find_and_sanitise(spark, docs, empty, clashing, fixture_rows):
    got = collections.Counter((r.doc_id, r.base_sha256) for r in pii.digest(pii.find(clashing)).collect())
    want = collections.Counter((i, hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in naive_spans(t or "" if i != 209 else "")).encode()).hexdigest()) for i, t, *_ in fixture_rows)
    assert got == want
    clean = pii.sanitise(clashing)
    assert clean.columns == clashing.columns and clean.count() == len(fixture_rows)
    text = {r.doc_id: r.text for r in pick(clean, doc_id="bigint", text="string").collect()}
    assert text[207] == "Write to <EMAIL> or <PHONE>, card <CARD>, host <IP> 300.1.1.1"
    assert text[0] == fixture_rows[0][1] and text[200] is None
    assert pii.find(empty).count() == 0 and pii.sanitise(empty).count() == 0


def test_pii_disclosing_terms(spark):
    rng = random.Random(2)
    filler = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(10)]
    rows = [(i, " ".join(rng.sample(filler, 30))) for i in range(300)]
    rows += [(1000 + i, " ".join(rng.sample(filler, 20)) + f" Zanzibar boss@corp.example.org {' '.join(rng.sample(filler, 5))}") for i in range(6)]
    rows += [(2000, "visit zanzibar today"), (2001, None), (2002, "")]
    found = {r.doc_id: r for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert all("term:" in found[1000 + i].spans and "email:" in found[1000 + i].spans for i in range(6))
    assert found[2000].spans == "term:6:14" and found[0].spans == "" and found[2001].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert "anzibar" not in clean[1000] and clean[2000] == "visit * today" and clean[0] == rows[0][1]


def test_pii_identifiers_equal_brute_force(spark, fixture_rows):
    rng = random.Random(3)
    token = lambda n: "".join(rng.choice("abcdef0123456789") for _ in range(n)) + "a1b2"
    common, shared, own = token(20), token(16), [token(30) for _ in range(5)]
    rows = [(i, t) for i, t, *_ in fixture_rows if t and i is not None and i < 60]
    rows += [(3000 + i, f'and token = "{own[i]}" {common} no{i}') for i in range(5)] + [(3100 + i, f"{common} {shared if i < 2 else ''} {i} words") for i in range(20)]
    rows += [(3200, rows[60][1]), (3201, "short1a2 4111222233334444555 aaaa-bbbb-cccc-dddd")]
    texts = {t for _, t in rows}
    n = collections.Counter(x for t in texts for x in set(re.findall(r"[A-Za-z0-9_-]+", t)))
    want = {}
    for i, t in rows:
        spans = []
        for m in re.finditer(r"[A-Za-z0-9_-]+", t):
            x = m[0]
            if len(x) >= 12 and len(re.findall("[A-Za-z]", x)) > 1 and len(re.findall("[0-9]", x)) > 1 and 1 - math.log(n[x]) / math.log(len(texts)) >= pii.THRESHOLD:
                spans.append(f"term:{m.start()}:{m.end()}")
        want[i] = ",".join(spans)
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert found == want and sum(map(bool, want.values())) == 6


# ---- quality rules

def test_quality_base_equals_brute_force(docs, empty, clashing, fixture_rows):
    want = collections.Counter()
    for i, t, *_ in fixture_rows:
        t = t or ""
        w = SPACE_WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        cover = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))] += 1
    out = quality_rules.quality_rules(clashing).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out) == want
    assert not any(r.kept and r.base_failed for r in out)
    assert sum(r.kept for r in out if r.doc_id is not None and r.doc_id < 60) >= 57
    assert quality_rules.quality_rules(empty).count() == 0


def test_char_model_sums_to_one(docs):
    m = quality_rules.fit(docs)
    for context in (b" ", b" t", b"the", b"sch", b"zzzz", b"enth"):
        grams = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)])
        assert np.exp(m.log_p(len(context) + 1, grams)).sum() == pytest.approx(1, abs=1e-6)


def test_perplexity_rejects_other_text(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice(["th", "er", "on", "an"]) for _ in range(2)) for _ in range(60)), "en") for i in range(200)]
    rows.append((900, " ".join("".join(rng.choice("qxzjkvwyp") for _ in range(5)) for _ in range(60)), "en"))
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not kept[900] and sum(kept[i] for i in range(200)) >= 198


def test_perplexity_rejects_junk_that_recurs(spark):
    rng = random.Random(9)
    text = lambda: ["".join(rng.choice(["th", "er", "on", "an", "ed", "ha"]) for _ in range(rng.randint(1, 3))) for _ in range(80)]
    rows = [(i, " ".join(text()), "en") for i in range(200)]
    rows += [(300 + i, " ".join(w + rng.choice("#*$%&") * 3 if rng.random() < 0.6 else w for w in text()), "en") for i in range(20)]
    rows += [(400 + i, " | ".join(text()), "en") for i in range(20)]
    kept = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert not any(kept[i] for i in kept if i >= 300) and sum(kept[i] for i in range(200)) >= 198


# ---- byte-level BPE

def test_bpe_equals_the_library(docs, empty, clashing, fixture_rows):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for i, t, *_ in fixture_rows:
        ids = lib.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), (t or "").encode())] += 1
    for sample in (bpe.SAMPLE_DOCS, 20):  # with all units known, and with some
        got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, bytes(r.decoded)) for r in bpe.decode(bpe.encode(clashing, sample_docs=sample)).select("doc_id", "n_tokens", "ids_sha256", "decoded").collect())
        assert got == want
    assert bpe.encode(empty).count() == 0


def test_bpe_of_long_words(spark):
    import time

    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    rng = random.Random(8)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(65, 3000))) for letters in ("ab", "abc", "etaoin", "the", "qxz", "é日ab", "abcdefghijklmnopqrstuvwxyz") for _ in range(12)]
    texts = [*words, "a" * 20_000, "=" * 5_000, "x " + "-=" * 700, " " * 3_000 + "x", "ab" * 64 + "=" * 64 + "c", "".join(rng.choice("abcdefgh") for _ in range(300_000))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    began = time.time()
    got = {r.doc_id: list(r.ids) for r in bpe.encode(rows, sample_docs=3).collect()}
    assert got == {i: lib.encode_ordinary(t) for i, t in enumerate(texts)}
    assert time.time() - began < 90


# ---- license scans

def test_license_base_and_fuzzy(spark, docs, empty, clashing, fixture_rows):
    got = collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(clashing).collect())
    want = collections.Counter()
    for i, t, *_ in fixture_rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t or ""))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    at.append(k)
                    labels.add(label)
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    assert got == want
    assert license_scan.scan(empty).count() == 0
    rows = [(1, "So: Licensd under the  Apache\nLicence, Version 2.0. End"), (2, "licensed under a different thing altogether"), (3, "Released under the MIT License")]
    out = {r.doc_id: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    assert out[1].labels == "apache-2.0" and 0.9 < out[1].score < 1 and out[2].labels == "" and out[2].score == 0 and out[3].labels == "mit"


def test_license_places_beside_better_ones_and_within_words():
    s = license_scan.Scanner(license_scan.NOTICES)
    first, second = "released undr the mt license", "released under the mit license"
    for texts in ((first, second), (second, first), (first, first, second, first)):
        want, at = [], 0
        for t in texts:
            want.append((at, at + len(t), "mit", 2 if t == first else 0))
            at += len(t) + 1
        assert [f[:4] for f in s.scan(" ".join(texts))] == want
    for text, span, label in (("x released under the mit licenses y", (2, 33), "mit"), ("licensed under a creative commons attributions", (0, 46), "cc-by"), ("prereleased under the mit license", None, None)):
        found = s.scan(text)
        assert [f[:3] for f in found] == ([(*span, label)] if span else []), (text, found)


def test_license_candidates_lose_nothing():
    import regex

    s, rng = license_scan.Scanner(license_scan.NOTICES), random.Random(6)
    for _ in range(150):
        notice, label = rng.choice(license_scan.NOTICES)
        n = license_scan.edits_of(notice)
        t = list(notice)
        for _ in range(rng.randint(0, n)):
            t[rng.randrange(len(t))] = rng.choice("abcdefgh")
        text = "some words " + "".join(t) + " more words"
        assert regex.search(f"(?:{regex.escape(notice)}){{e<={n}}}", text)
        assert any(a <= 11 + len(notice) and b >= 11 for _, a, b in s.windows(text))


# ---- language ID

def naive_phrases(text: bytes, reference: bytes) -> int:
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in reference:
            end += 1
        at = max(at + 1, end - 1)
        count += 1
    return count


def test_cross_parsing_equals_naive(docs, empty, clashing, fixture_rows):
    import pyarrow as pa

    from arborist.llm.words import chunk_of

    references = language_id.fit(clashing.where(~held_out(3, 1)))
    assert [k for k, _ in references] == ["de", "en", "fr"]
    parser = language_id.CrossParser(references)
    parts = [r[1] for r in fixture_rows[:60]]
    # texts of many pieces: all of a reference (one phrase), two of them, and many texts
    texts = [r[1] for r in fixture_rows] + [references[1][1].decode(), (references[0][1] + references[2][1]).decode(), "".join(parts), " x ".join(parts[::-1]) * 3]
    chunk = chunk_of(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    h = parser.entropies(chunk)
    for i, t in enumerate(texts):
        b = language_id._FOLD[np.frombuffer((t or "").encode(), np.uint8)].tobytes()
        for k, (_, r) in enumerate(references):
            r = language_id._FOLD[np.frombuffer(r, np.uint8)].tobytes()
            want = naive_phrases(b, r) * math.log2(len(r)) / max(len(b), 1)
            assert h[i, k] == pytest.approx(want)
    out = {r.doc_id: r for r in language_id.predict(clashing, references).collect()}
    assert all(out[i].lang_pred == fixture_rows[i][2] for i in range(60))
    assert {out[i].lang_pred for i in (200, 201, 202, 204)} == {"und"} and out[204].score == 0
    assert language_id.predict(empty, references).count() == 0
    assert {r.lang_pred for r in language_id.predict(docs, language_id.fit(empty)).collect()} == {"und"}


def test_license_places_are_the_document_s(spark):
    import regex

    rng = random.Random(14)
    notices = [(t, label) for t, label in license_scan.NOTICES if len(t) < 50]
    rows, want = [], {}
    for i in range(200):
        notice, label = rng.choice(notices)
        words = list(notice)
        for _ in range(rng.randint(0, license_scan.edits_of(notice))):  # edits of letters within the bound
            k = rng.randrange(1, len(words) - 1)
            if words[k].isalpha():
                words[k] = rng.choice("xyzw")
        said = "".join(words).replace(" ", rng.choice([" ", "  ", ",\n", " - "])).upper()
        before = " ".join(rng.choice(["né", "日本", "qqq", "..."]) for _ in range(rng.randint(0, 9)))
        before = before + " | " if before else ""
        rows.append((i, f"{before}{said}  ++ jjj"))
        want[i] = (label, len(before), len(before) + len(said))
    out = {r.doc_id: r for r in license_scan.digest(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()}
    for i, text in rows:
        places = [x.split(":")[:3] for x in out[i].notices.split(",")]
        label, a, b = want[i]
        assert any(int(s) < b and int(e) > a for _, s, e in places), (text, out[i])
        for name, s, e in places:
            blank = " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(text[int(s) : int(e)])))
            assert any(regex.fullmatch(f"(?b)(?:{regex.escape(n)}){{e<={license_scan.edits_of(n)}}}", blank) for n, x in license_scan.NOTICES if x == name)
