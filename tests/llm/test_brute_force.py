"""Decontamination, language ID and the whole pipeline against plain Python models that share no code with them."""

import math
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex

from loomdex.llm import common as C
from loomdex.llm import decontamination as D
from loomdex.llm import language_id as L
from loomdex.llm import source_mixing as X

SP, PUNCT = "\\x20\\x09-\\x0D", ".,;:!?\"')\\]"
HOLDERS = (D.NUM, D.UNIT, D.NAME)


# ---- decontamination


def split(text):
    return [w for w in regex.split(f"[{SP}]+", text) if w]


def template(text):
    text = regex.sub(rf"([0-9][{SP}])(?i:{D.UNITS})(?=[{PUNCT}]*(?:[{SP}]|$))", "\\1" + D.UNIT, text)
    text = regex.sub(rf"\p{{Lu}}(?<=[\p{{Ll}},;][{SP}]\p{{Lu}})[\p{{L}}'-]*", D.NAME, text)
    text = regex.sub("[0-9](?:[0-9.,:/]*[0-9])?", D.NUM, text)
    return regex.sub(rf"[{PUNCT}](?<=[^{SP}].)[{PUNCT}]*(?=[{SP}]|$)", "", text).lower()


def plain(text):
    return [w for w in (regex.sub(rf"^[(\[{PUNCT}]+|[(\[{PUNCT}]+$", "", w) for w in split(text.lower())) if w]


def slots(own, shape, at):
    return [(k, shape[at + k], regex.sub(f"[{PUNCT}]+$", "", own[at + k])) for k in range(D.WINDOW) if any(h in shape[at + k] for h in HOLDERS)]


def leaks(text, item):
    if text is None or item is None:
        return False
    own, shape = split(item), split(template(item))
    usable = [i for i in range(len(shape) - D.WINDOW + 1) if sum(not any(h in w for h in HOLDERS) for w in shape[i : i + D.WINDOW]) >= D.LITERAL]
    if not usable:
        words, wanted = plain(text), plain(item)
        return bool(regex.search(r"\p{L}", item) and wanted) and any(words[i : i + len(wanted)] == wanted for i in range(len(words)))
    mine, form = split(text), split(template(text))
    hits = [(pos, at) for at in usable for pos in range(len(form) - D.WINDOW + 1) if form[pos : pos + D.WINDOW] == shape[at : at + D.WINDOW]]
    need = min(len(usable), max(2, math.ceil(len(usable) * D.SHARE)))
    groups, before, run = {}, None, 0
    for pos, at in sorted(hits, key=lambda h: h[0] - h[1]):
        lies = pos - at
        run += before is not None and lies - before > D.SLACK
        before = lies
        for key in (("alike", lies), ("near", run), ("all", 0)):
            groups.setdefault(key, []).append((pos, at))
    for group in groups.values():
        same, seen = set(), {}
        for pos, at in group:
            a, b = slots(own, shape, at), slots(mine, form, pos)
            if [v for _, _, v in a] == [v for _, _, v in b]:
                same.add(at)
            for (_, kind, v), (_, _, u) in zip(a, b, strict=True):
                seen.setdefault((kind, v), set()).add(u)
        torn = any(len(u) > 1 for u in seen.values())
        if len({at for _, at in group}) >= need and (not torn or len(same) >= need):
            return True
    return False


def test_leaks_against_a_model(spark):
    rng = random.Random(17)
    words = "the a box train of red apples leaves and takes then how many are there in Paris Ann Bob Rome 5 7 120 9 km minutes, kg. when it (then) stands".split()
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [sentence(rng.choice([3, 7, 9, 14, 25])) for _ in range(14)] + ["What is it?", "3 4 5 6 7 8 9 10 11", None, "Add 3 4 5 6 7 8 9 10 11 12"]

    def altered(item):
        out = item.split()
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(out))
            out[k] = rng.choice(["6", "31", "Berlin", "and", out[k]])
        if rng.random() < 0.3:
            out.insert(rng.randrange(len(out)), rng.choice(words))
        return " ".join(out)

    docs = [sentence(rng.randrange(0, 60)) for _ in range(10)] + [None, ""]
    for item in [i for i in items if i] * 3:
        docs.append(f"{sentence(rng.randrange(9))} {altered(item)} {sentence(rng.randrange(9))} {altered(item) if rng.random() < 0.4 else ''}")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = D.find_items(df, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()
    want = {(i, k) for i, d in enumerate(docs) for k, item in enumerate(items) if leaks(d, item)}
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) > 20


# ---- language ID


def vector(text):
    low = [c.lower()[0] if regex.match(r"\p{L}", c) else " " for c in text]
    line = regex.sub(" +", " ", "".join(low)).strip(" ")
    if not line:
        return None
    letter = lambda c: L.letters(np.array([0 if c == " " else ord(c)]))[0].astype(float)
    line = f" {line} "
    out = np.zeros(L.DIMENSIONS)
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        out += np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
    return out / np.sqrt(out @ out)


def test_languages_against_a_model(spark):
    rng = random.Random(3)
    words = {"en": "the house with water".split(), "fr": "la maison avec de l'eau".split(), "ru": "дом вода человек с".split(), "el": "σπίτι νερό με και".split()}
    rows = [(i, " ".join(rng.choices(words[k], k=rng.randrange(1, 12))) + rng.choice(["", "!", " 12"]), k) for i in range(10) for k in words]
    rows += [(90, None, "en"), (91, "12 !", "fr"), (92, "дом вода", None), (93, "la maison", None), (94, "", None)]
    sums = {}
    for _, text, lang in rows:
        v = vector(text) if text and lang else None
        if v is not None:
            sums[lang] = sums.get(lang, 0) + np.round(v * 2**30)
    unit = {k: v / np.sqrt(v @ v) for k, v in sums.items()}
    mean = sum(unit.values()) / len(unit)
    unit = {k: (v - mean) / np.sqrt((v - mean) @ (v - mean)) for k, v in unit.items()}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in L.identify(df, L.learn(df)).collect():
        v = vector(r["text"]) if r["text"] else None
        if v is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            cos = {k: float(u @ v) for k, u in unit.items()}
            best = max(sorted(cos), key=lambda k: cos[k])
            assert r["lang_pred"] == best and r["score"] == pytest.approx((1 + cos[best]) / 2, abs=1e-5)


# ---- the pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_pipeline_against_a_model(spark):
    import corpus_pipeline

    rows = C.stored(corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA)).collect()
    # one of each group that five-word shingle sets of similarity 0.8 and more link
    sets = {}
    for r in rows:
        w = split(r["text"].translate({c: c + 32 for c in range(65, 91)}))
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[max(root(i), root(j))] = min(root(i), root(j))
    rows = [r for r in rows if root(r["doc_id"]) == r["doc_id"]]
    # windows of 35 words that occur elsewhere go
    texts = {r["doc_id"]: split(r["text"]) for r in rows}
    seen = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    left = []
    for r in rows:
        w, text = texts[r["doc_id"]], r["text"]
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        if gone:
            text = " ".join(x for i, x in enumerate(w) if i not in gone)
        if len(gone) < len(w):
            left.append((r["doc_id"], text, r["source"]))
    items = [r["text"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = [d for d in left if not any(leaks(d[1], item) for item in items)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(left, columns=["doc_id", "text", "source"]))
    want = {r[0]: r[1:] for r in con.sql(f"select doc_id, size, target, taken from ({X.ORACLE_SQL}) where taken > 0 or size = 0").fetchall()}
    got = {r["doc_id"]: (r["size"], r["target"], r["taken"]) for r in corpus_pipeline.run(spark, DATA).collect()}
    assert {i: (s, t) for i, (s, _, t) in got.items() if s} == {i: (s, t) for i, (s, _, t) in want.items() if s}
    assert all(got[i][1] == pytest.approx(want[i][1]) for i in got if got[i][0])
