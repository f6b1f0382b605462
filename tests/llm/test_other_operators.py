"""URL filters, decontamination, tokens, WARC, mixing, media and language ID."""

import base64
import hashlib
import io
import itertools
import math
import random
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import decontamination as D
from loomdex.llm import language_id as L
from loomdex.llm import lossless_webp as P
from loomdex.llm import source_mixing as X
from loomdex.llm import token_counts as K
from loomdex.llm import url_filters as U
from loomdex.llm import vp8l as V
from loomdex.llm import warc_bundles as Z

# ---- URL filters


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("https://x.net/", "x.net", "/", "net/", "block"),
        ("https://net/", "net", "/", "net/", "block"),
        ("https://x.net", "x.net", "", None, None),
        ("https://internet/", "internet", "/", None, None),
        ("https://example.com/de/?a", "example.com", "/de/", "example.com/de/", "block"),
        ("https://sub.wiki.org/fr/a#b", "sub.wiki.org", "/fr/a", "org/fr/", "allow"),
        ("https://x.net?y=http://z.org/fr/", "x.net", "", None, None),
        ("no scheme", "", "", None, None),
        ("", "", "", None, None),
        (None, "", "", None, None),
    ],
)
def test_url_rules(spark, url, host, path, rule, verdict):
    df = spark.createDataFrame([(url,)], "url string")
    h, p = U.host_and_path(F.col("url"))
    df = df.select(h.alias("h"), p.alias("p"))
    r, v = U.rule_of(F.col("h"), F.col("p"), U.RULES)
    assert tuple(df.select("h", "p", r.alias("r"), v.alias("v")).first()) == (host, path, rule, verdict)


def url_model(labelled, order):
    """The same models by dictionaries, without buckets."""
    counts = defaultdict(lambda: [0, 0])
    for s, good in labelled:
        for i in range(len(s)):
            for k in range(1, min(order, len(s) - i) + 1):
                counts[s[i : i + k]][not good] += 1
    context = defaultdict(lambda: [0, 0])
    for g, n in counts.items():
        for c in (0, 1):
            context[g[:-1], len(g)][c] += n[c]
    p = {}
    for g in sorted(counts, key=len):
        low = p[g[1:]] if len(g) > 1 else (1 / U.EVEN, 1 / U.EVEN)
        p[g] = tuple((counts[g][c] + U.M * low[c]) / (context[g[:-1], len(g)][c] + U.M) for c in (0, 1))

    def score(s):
        total = 0.0
        for i in range(len(s)):
            for k in range(1, min(order, len(s) - i) + 1):
                g = s[i : i + k]
                if g in p:
                    low = p[g[1:]] if k > 1 else (1.0, 1.0)
                    total += math.log(p[g][0] / p[g][1]) - math.log(low[0] / low[1])
        return total / len(s)

    return score


def test_url_models(spark):
    rng = random.Random(1)
    good = ["news-" + "".join(rng.choices("aeiou", k=5)) for _ in range(40)]
    bad = ["casino-" + "".join(rng.choices("xyz", k=5)) for _ in range(40)]
    rows = [(s, True, 1) for s in good] + [(s, False, 2) for s in bad]
    model = U.fit(spark.createDataFrame(rows, "s string, good boolean, n long"), 3)
    want = url_model([(s, g) for s, g, n in rows for _ in range(n)], 3)
    asked = [*good[:5], *bad[:5], "news-xyz", "x"]
    got = {r["s"]: r["score"] for r in U.score(spark.createDataFrame([(s,) for s in asked], "s string"), model, 3).collect()}
    assert all(got.get(s, 0) == pytest.approx(want(s), abs=1e-6) for s in asked)
    assert min(got[s] for s in good[:5]) > max(got[s] for s in bad[:5])


def test_url_models_keep_every_gram(spark):
    """More grams than the 65,536 buckets of old, with the settings of the query."""
    rng = random.Random(3)
    string = lambda: "\x02" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-/", k=30)) + "\x03"
    labelled = [(string(), i % 2 == 0) for i in range(2500)]
    assert len({s[i : i + k] for s, _ in labelled for i in range(len(s)) for k in range(1, U.ORDER + 1)}) > 2 * 65536
    model = U.fit(spark.createDataFrame([(s, g, 1) for s, g in labelled], "s string, good boolean, n long"))
    want = url_model(labelled, U.ORDER)
    asked = [s for s, _ in labelled[:20]] + [string() for _ in range(20)] + ["é", "\x02\x03"]
    got = {r["s"]: r["score"] for r in U.score(spark.createDataFrame([(s,) for s in asked], "s string"), model).collect()}
    assert [got.get(s, 0) for s in asked] == pytest.approx([want(s) for s in asked], abs=1e-6)


def test_url_verdicts(spark):
    pages = [(i, f"http://shop{i}.net/cheap-pills") for i in range(20)] + [(100 + i, f"http://site{i}.org/fr/article") for i in range(20)]
    pages += [(200, "http://shop7.biz/cheap-pills"), (201, "http://site3.eu/fr/article"), (202, None), (203, ""), (201, "http://site3.eu/fr/article")]
    got = U.judge(spark.createDataFrame([(*p, "c") for p in pages], "page_id long, url string, other string"))
    v = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    assert v[200] == (None, "block") and v[201] == (None, "allow") and v[202][1] == v[203][1] and v[0] == ("net/", "block")
    assert got.count() == len(pages) and "other" in got.columns
    assert U.judge(got.select("page_id", "url").limit(0)).count() == 0
    only = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.eu/x")], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in U.judge(only).collect()} == {1: "block", 2: "block"}
    none = spark.createDataFrame([(2, "http://b.eu/x")], "page_id long, url string")
    assert U.judge(none).first()["verdict"] == "allow"


# ---- decontamination

ITEM = "A train leaves the old station at 9 and travels 120 km to Lisbon while another train of the same kind waits for 45 minutes before it follows at once."


def test_decontamination(spark):
    other = ITEM.replace("9", "7").replace("120", "300").replace("Lisbon", "Porto").replace("45", "15")
    torn = "x. " + ITEM.replace("120 km to Lisbon", "80 miles to Porto")  # slots that still correspond
    docs = [(1, "Before. " + ITEM + " After that."), (2, other.upper()[:0] + "So: " + other), (3, "Something else entirely that has nothing to do with trains, and goes on for a while."), (4, None), (5, ""), (6, torn), (1, "Before. " + ITEM + " After that.")]
    items = [(10, ITEM), (11, "too short"), (12, None), (13, "1 2 3 4 5 6 7 8 9 10 11 12")]
    docs.append((7, "1 2 3 4 5 6 7 8 9 10 11 12 13"))
    got = D.find_items(spark.createDataFrame([(*d, "z") for d in docs], "doc_id long, text string, h string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    assert set(rows) == {(1, 10), (2, 10), (6, 10)} and got.count() == 3
    assert rows[1, 10]["verbatim"] and not rows[2, 10]["verbatim"] and rows[2, 10]["slots"] >= 3


def test_inconsistent_slots(spark):
    item = "If Ann has 5 apples and buys 5 more then how many apples would Ann have when 5 of them are eaten by noon today"
    same, torn = item.replace("5", "8"), item.replace("5", "8", 1).replace("5", "3", 1).replace("5", "6", 1)
    df = spark.createDataFrame([(1, same), (2, torn)], "doc_id long, text string")
    assert [r["doc_id"] for r in D.find_items(df, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [1]


def test_slots_of_each_occurrence(spark):
    item = "If Ann has 5 apples and buys 5 more then how many apples would Ann have when 5 of them are eaten by noon today"
    copy = lambda n: item.replace("5", str(n))
    more = copy(3).replace("apples would", "red apples would")  # a word put in
    stray = "Once Bob has 7 apples and buys 9 more then how they are carried home is another matter."
    torn = item.replace("5", "8", 1).replace("5", "3", 1).replace("5", "6", 1)
    twice = "we know the box of 3 red pens is on the table and we know the box of 4 red pens is on the table so say which is to go"
    docs = [(1, f"First. {copy(8)}. And then again: {copy(3)}."), (2, f"{copy(8)}. And some other words. {more}."), (3, f"{copy(8)}. {'word ' * 50}{stray}"), (4, f"{torn}. {torn}."), (5, twice.replace("3", "6").replace("4", "7"))]
    items = spark.createDataFrame([(1, item), (2, twice)], "item_id long, text string")
    got = D.find_items(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (2, 1), (3, 1), (5, 2)]
    assert not any(r["verbatim"] for r in got)


def test_short_items_verbatim(spark):
    numeric = "Add 3 4 5 6 7 8 9 10 11 12 13"
    items = [(1, "What is the capital of France?"), (2, numeric), (3, "Yes!"), (4, "1 2 3"), (5, ITEM), (None, "Of France"), (1, "What is the capital of France?")]
    docs = [(1, 'He asked: "what is the capital of France?" And then, yes.'), (2, "What is the capital of Spain? Not of France, it seems."), (3, "So " + numeric + " now"), (4, "So " + numeric.replace("13", "14") + " now 1 2 3"), (5, ""), (6, None), (7, "?"), (8, "yes")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for block in (D.BLOCK, 4):
        got = D.find_items(*frames, block=block).collect()
        assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=repr) == [(1, 1), (1, 3), (1, None), (2, None), (3, 2), (8, 3)]
        assert all(r["verbatim"] for r in got)


def test_decontamination_blocks_and_empties(spark):
    docs = spark.createDataFrame([(1, ITEM), (2, "nothing of the kind is said in this document at all")], "doc_id long, text string")
    items = spark.createDataFrame([(i, ITEM) for i in range(3)], "item_id long, text string")
    whole, parts = (sorted(map(tuple, D.find_items(docs, items, block=b).collect())) for b in (D.BLOCK, 20))
    assert whole == parts and len(whole) == 3
    assert D.find_items(docs.limit(0), items).count() == 0 and D.find_items(docs, items.limit(0)).count() == 0
    assert [r["doc_id"] for r in D.drop_contaminated(docs, items).collect()] == [2]


# ---- tokens


def test_tokens(spark):
    import public_tokenizers
    import sentencepiece

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    bits = ["a", "the", "ing", "é", "漢字", "😀", "\n", "\t", " ", "  ", "   ", "▁", "0", "<s>", "</s>", "<0x41>", "un", "\x00", "ﬁ", "’"]
    texts = ["".join(rng.choices(bits, k=rng.choice([2, 9, 60]))) for _ in range(150)]
    texts += ["", None, " ", "x" * 3000, "漢" * 700, "hello world " * 2000, "".join(rng.choices("abcdefgh", k=4000))]
    got = K.count_tokens(spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, n long".replace("n long", "n string")), path).collect()
    assert [(r["n_bytes"], r["n_tokens"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(len((t or "").encode()), len(sp.encode(t or ""))) for t in texts]
    assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)


# ---- WARC


def test_bundles(spark, tmp_path):
    big = "é" * 600
    pages = [(1, "u1", big), (2, "u2", big), (9, None, big), (3, "u\r\n3", "small"), (4, "u4", "small"), (5, "u5", None), (9, None, big), (None, "n", big), (None, "m", "alone" * 300)]
    pages += [(100 + i, f"u{i}", f"page {i} " * 200) for i in range(30)]
    df = Z.roles(spark.createDataFrame(pages, "page_id long, url string, html string"))
    index = Z.write_bundles(df.drop("html"), f"file://{tmp_path}", frame_bytes=4000, bundle_bytes=3000)
    rows = Z.read_bundles(index).collect()
    assert len(rows) == len(pages) and index.select("bundle").distinct().count() > 1 and index.agg(F.max("frame")).first()[0] >= 1
    by = defaultdict(list)
    for r in rows:
        by[r["page_id"]].append(r)
    assert [r["headers"]["warc-type"] for r in by[9]] == ["response"] * 2
    assert all(by[i][0]["headers"]["warc-type"] == "revisit" and by[i][0]["headers"]["warc-refers-to"] == "<urn:page:9>" and not by[i][0]["block"] for i in (1, 2))
    assert sorted(r["headers"]["warc-type"] for r in by[None]) == ["response", "revisit"]
    assert by[3][0]["block"] == b"small" and by[4][0]["headers"]["warc-type"] == "response" and by[5][0]["block"] == b""
    assert all(r["headers"]["warc-payload-length"] == str(len((t or "").encode())) for i, _, t in pages for r in by[i] if i and i != 9)
    one = index.filter("page_id = 107").first()
    head, block = Z.read_record(one["bundle"], one["frame"], one["at"])
    assert head["warc-target-uri"] == "u7" and block == ("page 7 " * 200).encode() and hashlib.sha1(block).hexdigest() == head["warc-payload-digest"][5:]
    import zstandard

    raw = Path(one["bundle"].removeprefix("file://")).read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1")  # an ordinary decoder reads a bundle as one stream
    assert Z.write_bundles(df.drop("html").limit(0), f"file://{tmp_path}").count() == 0


# ---- mixing


def fill(sizes, weights, share=1.5, most=2.0):
    """Water filling round by round."""
    target, free, left = {}, list(sizes), share * sum(sizes.values())
    while free:
        total = sum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / total > most * sizes[s]]
        if not over:
            return target | {s: left * weights[s] / total for s in free}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(target[s] for s in over)
        free = [s for s in free if s not in over]
    return target


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(["hot"] * 12 + ["a", "B", "é", "zz", None])) for i in range(3000)]
    rows += [(None, "x y", "a"), (5000, None, "a"), (5001, "", "void"), (7, rows[7][1], rows[7][2])]
    got = X.mix(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, h long")).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s) + [None]
    want = fill(dict(sizes), {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(0 <= want[s] - taken[s] + 1e-6 <= 2 * largest[s] + 1e-6 for s in sizes)
    again = X.mix(spark.createDataFrame([(*r, 1) for r in rows[::-1]], "doc_id long, text string, source string, h long")).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert X.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# ---- media


def images():
    rng = np.random.default_rng(1)
    palette = rng.integers(0, 256, (200, 4)).astype(np.uint8)
    yield rng.integers(0, 256, (7, 9, 4)).astype(np.uint8)
    yield rng.integers(0, 3, (17, 33, 4)).astype(np.uint8)
    yield np.zeros((5, 16, 4), np.uint8)
    for n in (2, 4, 13, 200):
        yield palette[:n][rng.integers(0, n, (11, 21))]
    yield np.tile(rng.integers(0, 256, (4, 5, 4)).astype(np.uint8), (6, 7, 1))


def test_webp_round_trips():
    for img in images():
        assert (V.decode(V.encode(img)) == img).all()
        few = len(np.unique(img.reshape(-1, 4), axis=0)) <= 256
        for p, c, g, pal, cache, meta in itertools.product((False, True), (False, True), (False, True), (False, True), (0, 1, 10), (0, 2)):
            if few or not pal:
                data = V.encode_full(img, predictor=p, cross=c, green=g, palette=pal, cache_bits=cache, meta_bits=meta)
                assert (V.decode(data) == img).all(), (p, c, g, pal, cache, meta)


def test_webp_bulk_forms():
    """The bulk encoder's transforms, read by whole arrays, and references longer than one may be."""
    V.taken.clear()
    for img in [*images(), np.zeros((1, 1, 4), np.uint8), np.tile(np.arange(200, dtype=np.uint8).reshape(1, 50, 4), (300, 1, 1))]:
        few = len(np.unique(img.reshape(-1, 4), axis=0)) <= 256
        for pal, p, c, cache in itertools.product((False, True), (False, True), (False, True), (0, 1, 6, 11)):
            if few or not pal:
                assert (V.decode(V.encode(img, palette=pal, predictor=p, cross=c, cache_bits=cache)) == img).all(), (img.shape, pal, p, c, cache)
    assert {"prefix codes", "references", "cache", "predictor", "cross-colour", "palette"} <= set(V.taken)


def test_webp_of_others():
    """A file that another encoder made: one transparent pixel, as browsers are asked for to see whether they read the format."""
    img = V.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA=="))
    assert img.shape == (1, 1, 4) and img[0, 0, 3] == 0


def test_webp_arrays_and_pixels_agree(monkeypatch):
    rng = np.random.default_rng(4)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(60)]
    payload = b" ".join(words[k] for k in rng.integers(0, 60, 900))
    files = [V.encode(P.to_image(payload, each), **form) for each, form in P.FORMS] + [V.encode_full(P.to_image(payload[:900]), cache_bits=5, green=True)]
    fast = [V.decode(f) for f in files]
    monkeypatch.setattr(V, "_all_pixels", lambda *_: None)
    assert all((V.decode(f) == img).all() for f, img in zip(files, fast, strict=True))


def test_media_forms_and_pieces(monkeypatch):
    """Every part of the decoder is put to use by what is stored, and long payloads come back from several files."""
    V.taken.clear()
    rng = random.Random(8)
    for k in range(40):
        payload = P.padded(" ".join(rng.choice("alpha beta gamma delta of the".split()) for _ in range(rng.randrange(1, 300))).encode() + bytes([k]))
        media = P.to_media(payload)
        assert P.from_media(media, len(payload))[0].tobytes() == payload and media == P.to_media(payload)
    assert {"prefix codes", "references", "cache", "predictor", "cross-colour", "palette"} <= set(V.taken)
    monkeypatch.setattr(P, "PIECE", 1000)
    for n in (999, 1000, 1001, 5003):
        payload = P.padded(bytes(rng.randrange(256) for _ in range(n)))
        back, shapes = P.from_media(P.to_media(payload), len(payload))
        assert back.tobytes() == payload and len(shapes) == -(-len(payload) // 1000)


def test_webp_cost():
    """The files are what they were, and a text's way there and back costs no more than so many times some plain work."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlucmfwypvbgk") for _ in range(rng.randrange(2, 9))) for _ in range(150)]
    payload = P.padded(" ".join(rng.choice(words) for _ in range(450)).encode())
    files = [V.encode_argb(*P.to_argb(payload, each), **form) for each, form in P.FORMS]
    assert hashlib.sha256(b"".join(files)).hexdigest() == "54feb8d9c22fddcdf3d5bed78e651b09e7e10d8d8c58a9260259e5d2da4e93a9"

    def codec():
        for each, form in P.FORMS:
            V.decode_argb(V.encode_argb(*P.to_argb(payload, each), **form))

    def plain():  # half steps of Python, half small and middling arrays
        a, small, x = np.arange(12_000) * 7 % 12_000, np.arange(60), 1
        for k in range(20_000):
            x = x * 5 + k & 0xFFFF
        for _ in range(30):
            a = (a[a] ^ 1) % 12_000
        for _ in range(600):
            small = small[small.argsort(kind="stable")]
        return x, a, small

    best = {codec: math.inf, plain: math.inf}
    for k in range(150):
        for f in best:
            begun = time.process_time()
            f()
            best[f] = min(best[f], time.process_time() - begun)
        if k > 20 and best[codec] < 1.9 * best[plain]:  # 2.0 to 2.3 before, 1.3 to 1.8 now: other work on the machine tells
            break
    else:
        raise AssertionError(best[codec] / best[plain])


def test_webp_predictors_by_hand():
    left, top, right, corner = [10, 20, 30, 255], [50, 60, 70, 255], [90, 100, 110, 255], [5, 15, 200, 255]
    got = [V._predict(m, left, top, right, corner) for m in range(14)]
    assert got[0] == [255, 0, 0, 0] and got[1] == left and got[2] == top and got[3] == right and got[4] == corner
    assert got[7] == [30, 40, 50, 255] and got[12] == [55, 65, 0, 255] and got[13][:2] == [42, 52] and got[5] == [50, 60, 70, 255]


def test_webp_broken(spark):
    good = V.encode(np.zeros((4, 16, 4), np.uint8))
    df = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"RIFF")), (4, bytearray(b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0"))], "id long, media binary")
    rows = {r["id"]: r for r in P.pixels(df).collect()}
    assert (rows[1]["width"], rows[1]["height"], len(rows[1]["pixels"])) == (16, 4, 256) and rows[1]["error"] is None
    assert all(rows[i]["pixels"] is None and rows[i]["error"] for i in (2, 3, 4))


def test_media(spark):
    texts = ["", None, "abc", "abc", "é" * 100, "x" * 64, "y" * 65, "".join(map(chr, range(32, 1200))) * 30]
    got = P.features(P.store(spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, pixels string"))).collect()
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        want = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    by = {r["doc_id"]: r for r in got}
    assert by[2]["media_sha256"] == by[3]["media_sha256"] and by[0]["feature"] == by[1]["feature"] and by[0]["pixels"] == "m"
    wide = b"\1\2\3\4" * (16 * 16384 + 5)
    img = P.to_image(wide)
    assert img.shape[0] <= V.MAX_SIDE and V.decode(V.encode(img)).reshape(-1)[: len(wide)].tobytes() == wide


# ---- language ID


def test_languages(spark):
    rng = random.Random(6)
    parts = {"aa": "ka ri to mo na shi", "bb": "sch ein und ver ung tz", "cc": "eau oux ion ette que ère"}
    text = lambda k: " ".join("".join(rng.choices(parts[k].split(), k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60)))
    rows = [(i, text(k), k, "s") for i, k in enumerate(rng.choices("aa bb cc".split(), k=240))]
    rows += [(900, None, "aa", "s"), (901, "123 !?", "bb", "s"), (902, "", "aa", "s"), (903, text("bb"), None, "s"), (None, text("cc"), "cc", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    docs = df.select("doc_id", "text", "lang").withColumn("held_out", L.held_out())
    model = L.learn(docs.filter("not held_out"))
    got = L.identify(docs, model).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(held) > 40 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.97
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (900, 901, 902)) and by[903]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in got) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got if r["doc_id"] is not None)
    assert L.learn(docs.limit(0)) == {} and {r["lang_pred"] for r in L.identify(docs, {}).collect()} == {"und"}
    assert L.identify(docs.limit(0), model).count() == 0


def test_hypervectors():
    a, b = L.encode("the cat sat on the mat"), L.encode("The CAT  sat, on the mat!")
    assert a == pytest.approx(b) and a @ a == pytest.approx(1) and abs(a @ L.encode("zzyx qwv kkj")) < 0.35 and L.encode("42 😀") is None and L.encode("𐐷") is not None
