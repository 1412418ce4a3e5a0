"""Importance resampling, decontamination and vector codes against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovelink.llm import codes, decontaminate, importance
from grovelink.llm.queries import op11_importance_resampling, op12_winnowing, op13_grid_codes

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG_TEXT = " ".join(f"w{i % 977}-{i % 31}" for i in range(60_000))


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(ASCII_LOWER))


def frame(spark, rows, kind):
    return spark.createDataFrame(rows, kind)


DOCS = "doc_id long, text string, n_features string, `od d``.x` int, _metadata string, document int"


def doc_rows():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{w}" for w in rng.integers(0, 40, n)) for n in rng.integers(0, 60, 80)]
    texts += [None, "", " \t.,;", "É Ünïcode\x00Ünïcode\x7f12", LONG_TEXT, texts[0], texts[0].upper()]
    ids = [*range(len(texts) - 3), 3, 3, None]
    return [(i, t, "x", 1, "m", 2) for i, t in zip(ids, texts)]


def plain_resample(docs, target, percent, least, longest, buckets, seed="2024"):
    def features(text):
        words = plain_words(text)
        grams = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return [zlib.crc32(g.encode()) % buckets for g in grams], len(words)

    found = [features(t) for _, t in docs]
    s, t = [0] * buckets, [0] * buckets
    for own, _ in found:
        for b in own:
            s[b] += 1
    for text in target:
        for b in features(text)[0]:
            t[b] += 1
    big_s, big_t = sum(s) + buckets, sum(t) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(buckets)]
    rows = []
    for (doc, _), (own, words) in zip(docs, found):
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((doc, words, len(own), weight, weight + noise))
    able = sorted(
        (r for r in rows if r[1] >= least),
        key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]),
    )
    drawn = able[: percent * len(able) // 100]
    out = [(*r, n + 1) for n, r in enumerate(drawn)]
    for r in drawn:
        rows.remove(r)
    return out + [(*r, None) for r in rows]


def by_text(rows):
    return sorted(map(str, rows))


@pytest.mark.parametrize("longest,buckets", [(1, 10_000), (3, 257)])
def test_resample(spark, longest, buckets):
    rows = doc_rows()
    target = ["T1 t2 t3. t1", None, "", LONG_TEXT[:5000]]
    table = frame(spark, rows, DOCS)
    wanted = frame(spark, [(t, "x") for t in target], "text string, bucket string")
    options = dict(percent=25, least_words=20, longest=longest, buckets=buckets)
    got = importance.resample(table, wanted, **options)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    want = plain_resample([(r[0], r[1]) for r in rows], target, 25, 20, longest, buckets)
    assert by_text(tuple(r) for r in got.collect()) == by_text(want)
    stays = importance.drawn_documents(table, wanted, **options)
    assert stays.columns == table.columns
    drawn = sorted((r[0] is None, r[0] or 0) for r in want if r[-1])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in stays.collect()) == drawn
    assert importance.resample(table.limit(0), wanted.limit(0)).count() == 0
    assert importance.resample(table, wanted.limit(0)).count() == len(rows)


def plain_hits(docs, items, span=10):
    held = {}
    for item, text in items:
        words = plain_words(text)
        n = min(len(words), span)
        for i in range(len(words) - n + 1) if n else ():
            held.setdefault(tuple(words[i : i + n]), set()).add(item)
    lengths = {len(w) for w in held}
    out = []
    for doc, text in docs:
        words, hit, found = plain_words(text), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                own = held.get(tuple(words[i : i + n]))
                if own:
                    hit |= set(range(i, i + n))
                    found |= own
        listed = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), listed))
    return out


@pytest.mark.parametrize("gram", [1, 6, 10])
def test_contaminated(spark, gram):
    rng = np.random.default_rng(6)
    rows = doc_rows()
    base = [r[1] for r in rows if r[1] and 30 < len(plain_words(r[1])) < 100]
    parts = [" ".join(plain_words(t)[3 : 3 + n]) for t, n in zip(base, (9, 10, 11, 25, 14, 10, 1))]
    items = [(i, p.upper().replace(" ", ", ")) for i, p in enumerate(parts[:-1])]
    items += [(100, "t1 t2"), (101, "t5"), (102, None), (103, "..."), (3, parts[3] + " and more words of its own here"),
              (None, parts[4]), (11, parts[4]), (2, parts[4]), (200, LONG_TEXT[-4000:]), (0, items[0][1])]
    tail = [(500 + n, " ".join(rng.permutation([parts[n % 5], "x y z", parts[3], "q"])), "x", 1, "m", 2) for n in range(30)]
    table = frame(spark, rows + tail, DOCS)
    wanted = frame(spark, [(i, t, 1) for i, t in items], "item_id long, text string, length int")
    want = plain_hits([(r[0], r[1]) for r in rows + tail], items)
    done = decontaminate.contaminated(table, wanted, gram=gram).collect()
    assert by_text((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in done) == by_text(want)
    assert sum(n > 0 for _, _, n, _ in want) > 30 and sum(not n for _, _, n, _ in want) > 3
    for r in done:
        assert sum(s.stop - s.start for s in r.spans) == r.n_hit
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:]))
    clean = decontaminate.clean_documents(table, wanted, gram=gram)
    assert clean.columns == table.columns
    assert clean.count() == sum(not n for _, _, n, _ in want)
    assert decontaminate.contaminated(table.limit(0), wanted).count() == 0
    assert decontaminate.contaminated(table, wanted.limit(0)).where("n_hit > 0").count() == 0


def test_fingerprints_miss_no_shared_run():
    rng = np.random.default_rng(7)
    for gram in (1, 4, 6, 9):
        one = rng.integers(0, 4, 200).astype(np.uint64)
        two = np.concatenate([rng.integers(0, 4, 30).astype(np.uint64), one[70:95], one[5:16]])
        prints = [decontaminate.fingerprints(h, 10, gram) for h in (one, two)]
        for i in range(len(two) - 9):
            for j in np.flatnonzero([(one[j : j + 10] == two[i : i + 10]).all() for j in range(191)]):
                assert prints[0][j] == prints[1][i]


def plain_codes(rows, parts, entries, rounds, scale=4096):
    sizes = [len(v) for _, v, _ in rows]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n))
    rows = sorted((r for r in rows if len(r[1]) == size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-size // parts)
    bound = 1 << 27
    whole = [
        [int(min(max(math.floor(x * scale), -bound), bound)) for x in v] + [0] * (width * parts - size)
        for _, v, _ in rows
    ]
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def near(part, book):
        away = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
        return away.index(min(away)), min(away)

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[0], []).append(v[p])
            for e, own in groups.items():
                books[p][e] = tuple(sum(c) // len(own) for c in zip(*own))
    done = [[near(v[p], books[p]) for p in range(parts)] for v in cut]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return [(r[0], r[2], [e for e, _ in d], sum(x for _, x in d)) for r, d in zip(rows, done)], digest


@pytest.mark.parametrize("size,count,bits", [(16, 300, 8), (10, 60, 3), (16, 5, 20)])
def test_codes(spark, size, count, bits):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, size)) / 4
    rows = [
        (int(i), [float(x) for x in centres[i % 6] + rng.normal(size=size) / 20], None if i % 5 == 0 else int(i % 3))
        for i in range(count)
    ]
    rows += [(1, rows[1][1], 0), (1, rows[2][1], 0), (None, rows[0][1], None), (2000, [1e30] * size, 1), (2001, [0.0] * size, 1)]
    odd = [(900, None, 1), (901, [float("nan")] * size, 1), (902, [None] * size, 1), (903, [float("-inf")] + [0.0] * (size - 1), 1),
           (904, [], 1), (905, [1.0, 2.0], 1)]
    kind = "vec_id long, embedding array<double>, label int, code string, _label int"
    table = frame(spark, [(*r, "c", 7) for r in rows + odd], kind)
    want, digest = plain_codes(rows, 4, 8, 3)
    done, books = codes.compress(table, parts=4, entries=8, rounds=3, bits=bits)
    got = codes.with_label_errors(done).collect()
    assert books.digest() == digest
    labelled = [(i, None if b is None else str(b), c, e) for i, b, c, e in want]
    assert by_text((r.vec_id, r.label, r.code, r.error) for r in got) == by_text(labelled)
    for r in got:
        assert r.label_error == sum(e for _, b, _, e in labelled if b == r.label)
    none, empty = codes.compress(table.limit(0))
    assert none.count() == 0 and empty.books == []
    assert codes.with_label_errors(none).count() == 0


def test_memo_keeps_the_nearest():
    rng = np.random.default_rng(9)
    book = rng.integers(-500, 500, (16, 4))
    book[7] = book[3]
    points = rng.integers(-700, 700, (5000, 4))
    want = ((points[:, None] - book[None]) ** 2).sum(axis=2)
    for bits, size in ((4, 1 << 16), (6, 100), (12, 10)):
        memo = codes.CellMemo(book, bits, size)
        for at in range(0, 5000, 700):
            best, away = memo.nearest(points[at : at + 700])
            assert (best == want[at : at + 700].argmin(axis=1)).all()
            assert (away == want[at : at + 700].min(axis=1)).all()
        assert len(memo.slots) <= max(size, 700)
    fine = codes.CellMemo(book, 5)
    assert fine.candidates(points).mean() < 0.5


def test_queries_have_their_columns(spark):
    folder = "/root/testdata/sf0.001"
    assert op11_importance_resampling(spark, folder).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert op12_winnowing(spark, folder).columns == [
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = op13_grid_codes(spark, folder)
    assert rows.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert rows.where(F.length("code") != 16).count() == 0
