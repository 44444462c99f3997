import math
import random
import re

from tidemark.llm import license_scan as L
from tidemark.llm.queries import QUERIES


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def indexed():
    """Words of the templates that are rare among them, by the rule that the operator states."""
    of = [set(t[1].split()) for t in L.TEMPLATES]
    return {w for w in set().union(*of) if w not in L.COMMON and math.log(len(of) / sum(w in x for x in of)) >= L.MIN_IDF}


def plain(text):
    """Every template laid at every place of the text, without an index."""
    w = words(text)
    places, labels = [], set()
    for p, label in L.BASE.items():
        p = p.split()
        own = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    rare, score, all_labels = indexed(), 0.0, set(labels)
    for label, said, mandatory in L.TEMPLATES:
        t = said.split()
        can = [q for q, x in enumerate(t) if x in rare]
        best = max((sum(0 <= d + q < len(w) and w[d + q] == t[q] for q in can) for d in range(-len(t), len(w))), default=0)
        share = min(1.0, best / max(1, len(can)))
        if share >= L.MIN_SHARE and all(f" {p} " in f" {' '.join(w)} " for p in mandatory):
            all_labels.add(label)
            score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), 1.0 if places else round(score, 9)


def tuples(rows):
    return [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)) for r in rows]


def test_equals_plain_version(spark):
    rng = random.Random(9)
    vocab = [w for t in L.TEMPLATES for w in t[1].split()] + ["foo", "Bär", "x1"]
    texts = [None, "", " -- ", "Under THE mit-license under the MIT License", "cc by nc cc by nc by nc", "Apache License, Version 2.0", "license " * 500, "\u212aelvin under the MIT L\u0130CENSE", "made available \u212a"]
    for _, t, _ in L.TEMPLATES:
        texts += [t.title(), f"foo {t}, bar. {t}", " ".join(t.split()[1:]), t.replace(" the ", " a the ", 1)]
    texts += [" ".join(rng.choices(vocab, k=rng.randint(1, 60))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, "l", 3) for i, t in enumerate(texts)], "doc_id long, text string, labels string, w int").repartition(3)
    out = L.scan(df)
    assert out.columns == ["doc_id", "text", "w", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    rows = out.orderBy("doc_id").collect()
    for t, got in zip(texts, tuples(rows), strict=True):
        assert got == plain(t), t
    assert L.scan(df.limit(0)).count() == 0


def test_notices_are_found(spark):
    df = spark.createDataFrame([(i, f"Some words before. {t}. And after it") for i, (_, t, _) in enumerate(L.TEMPLATES)], "doc_id long, text string")
    for r in L.scan(df).orderBy("doc_id").collect():
        assert L.TEMPLATES[r.doc_id][0] in r.labels.split(",") and r.score >= L.MIN_SHARE


def test_query_on_real_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    rows = QUERIES["op4_license_scan"](spark, sf).orderBy("doc_id").collect()
    for d, got in zip(docs, tuples(rows), strict=True):
        if len(d.text) < 3000 or any(got[3:6]):
            assert got == plain(d.text)
    for d, r in zip(docs, rows, strict=True):
        assert ("GNU General Public License, version 3" in d.text) == ("gpl-3" in r.labels)


def test_long_texts_and_several_notices(spark):
    notices = [t for _, t, _ in L.TEMPLATES]
    everyday = " ".join(sorted(w for w, x in L.build_index()[1].items() if x > 2.8)) + " plain words"
    gpl = "licensed under the gnu general public license version 3"
    texts = [f"{notices[0]}. {notices[4]}", ". ".join(notices), f"{everyday} {gpl} {everyday}", *(f"{everyday}. {t}. {everyday}" for t in notices)]
    want = [{"mit", "bsd"}, {t[0] for t in L.TEMPLATES}, {"gpl-3"}, *({t[0]} for t in L.TEMPLATES)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for w, r in zip(want, L.scan(df).orderBy("doc_id").collect(), strict=True):
        assert w <= set(r.labels.split(",")), r


def test_every_subset_of_notices_gives_its_labels(spark):
    rng = random.Random(3)
    subsets = [[k] for k in range(len(L.TEMPLATES))] + [rng.sample(range(len(L.TEMPLATES)), rng.randint(2, len(L.TEMPLATES))) for _ in range(120)]
    filler = [" plain words between the notices ", ".\n\n", " file files author code rights purpose person "]
    texts = ["".join(rng.choice(filler) + L.TEMPLATES[k][1].title() for k in own) for own in subsets]
    rows = L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).orderBy("doc_id").collect()
    for own, text, r, got in zip(subsets, texts, rows, tuples(rows), strict=True):
        assert {L.TEMPLATES[k][0] for k in own} <= set(r.labels.split(",")) and got == plain(text)
