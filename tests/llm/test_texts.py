"""Packing, leaked evaluation texts and personal information."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import evalleak, packing, pii, pii_labels, pii_model


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, bin string, tokens int")


def test_token_counts(spark):
    texts = ["", None, "  ", "a b_c, d!! é½ #x", "(x)...y z"]
    got = {r["doc_id"]: r["tokens"] for r in packing.word_sizes(docs(spark, texts)).collect()}
    assert got == {i: len(re.findall(r"\w+|[^\w\s]+", t or "")) for i, t in enumerate(texts)}


def test_best_fit_and_bound():
    rng = np.random.default_rng(0)
    for cap in (10, 100):
        for _ in range(30):
            s = rng.integers(1, cap + 1, rng.integers(1, 60))
            where, fill = packing.best_fit_decreasing(s, np.argsort(-s, kind="stable"), cap)
            assert (np.bincount(where, s) == fill).all() and fill.max() <= cap
            assert -(-s.sum() // cap) <= packing.lower_bound(s, cap) <= len(fill)
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3  # the volume alone would say 2


def test_packing_keeps_every_token(spark):
    r = random.Random(2)
    sizes = [r.choice([0, 1, 5, 40, 60, 64, 99, 100, 101, 200, 357]) for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens int").repartition(9)
    got = packing.pack(df, 100).collect()
    per_doc, per_bin = {}, {}
    for x in got:
        per_doc.setdefault(x["doc_id"], []).append(x)
        per_bin[x["container_id"]] = per_bin.get(x["container_id"], 0) + x["tokens"]
    assert {d: sum(x["tokens"] for x in xs) for d, xs in per_doc.items()} == {d: s for d, s in enumerate(sizes) if s}
    assert max(per_bin.values()) <= 100 and all(per_bin[x["container_id"]] == x["fill"] for x in got)
    assert {d for d, xs in per_doc.items() if any(x["cut"] for x in xs)} == {d for d, s in enumerate(sizes) if s > 100}
    assert all(len(xs) == -(-sizes[d] // 100) for d, xs in per_doc.items())
    rest = np.array([s % 100 for s in sizes if s % 100])
    report, certs = packing.containers(packing.pack(df, 100), 100).first(), packing.certificates(packing.pack(df, 100)).collect()
    assert report["containers"] == len(per_bin) and report["gap"] == len(per_bin) - report["bound"] >= 0 and report["bound"] == packing.lower_bound(np.array([x["tokens"] for x in got]), 100)
    assert certs and all(r["bound"] <= r["bins"] and r["certified"] == (r["bound"] == r["bins"]) for r in certs)
    assert len(per_bin) <= sum(s // 100 for s in sizes) + packing.lower_bound(rest, 100) * 1.03 + 2


def test_packing_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, tokens int")
    assert packing.pack(empty).isEmpty() and packing.containers(packing.pack(empty)).first()["containers"] == 0


VOCAB = [f"{a}{b}{c}" for a in ("br", "st", "m", "tr", "gl") for b in ("a", "o", "u") for c in ("nt", "lk", "rg", "pp", "sh", "x")]


def prose(r, n):
    return " ".join(r.choices(VOCAB, k=n))


def test_leaks(spark):
    r = random.Random(5)
    clause = " ".join(VOCAB[:12])
    items = [(i, "s", "en", f"{prose(r, 50)} {clause} {prose(r, 30)}") for i in range(6)]
    ws = [t.split() for *_, t in items]
    texts = [prose(r, 150) for _ in range(60)]
    texts[3] = f"{prose(r, 60)} {' '.join(ws[0])} {prose(r, 60)}"
    texts[4] = f"{prose(r, 60)} <p>{' '.join(ws[1][5:50]).upper().replace(' ', chr(10))}</p> {prose(r, 60)}"
    texts[5] = f"{prose(r, 30)} {' '.join(ws[2][:30])} {prose(r, 15)} {' '.join(ws[2][30:60])}"
    texts[6] = " ".join(w.replace("o", "0").replace("s", "5").replace("l", "1") for w in ws[3])
    texts[7] = f"{prose(r, 80)} {clause} {prose(r, 80)}"  # a clause that all items share
    texts[8] = f"{prose(r, 80)} {' '.join(ws[4][:10])} {prose(r, 80)}"  # too little
    texts[9] = " ".join(random.Random(1).sample(ws[5], len(ws[5])))  # in another order
    texts += [None, "", "  \n"]
    df = docs(spark, texts)
    its = spark.createDataFrame([*items, (98, "s", "en", None), (99, "s", "en", "")], "item_id long, suite string, lang string, text string")
    assert {(x["doc_id"], x["item_id"]) for x in evalleak.leaks(df, its).collect()} == {(3, 0), (4, 1), (5, 2), (6, 3)}
    assert evalleak.leaks(df.limit(0), its).isEmpty() and evalleak.leaks(df, its.limit(0)).isEmpty()


def test_leaks_of_repeated_and_short_items(spark):
    r = random.Random(6)
    clause = " ".join(r.sample(VOCAB, 30))
    base = [prose(r, 80) for _ in range(3)]
    near = [f"{base[1]} {prose(r, 3)}" for _ in range(4)]
    with_clause = [f"{prose(r, 20)} {clause} {prose(r, 20)}" for _ in range(4)]
    items = [base[0]] * 3 + near + with_clause + ["quorvex", "zembly wattock", "ulmic fennard oskel brintoy vask"]
    its = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(items)], "item_id long, suite string, lang string, text string")
    texts = [prose(r, 150) for _ in range(60)] + [f"{prose(r, 60)} {clause} {prose(r, 60)}" for _ in range(40)]
    texts[1] = f"{prose(r, 60)} {items[0]} {prose(r, 60)}"  # three items with this text
    texts[2] = f"{prose(r, 60)} {near[0]} {prose(r, 60)}"  # four items that differ in their last words only
    texts[3] = f"{prose(r, 60)} {with_clause[2]} {prose(r, 60)}"
    texts[4] = f"{prose(r, 60)} Quorvex {prose(r, 60)}"
    texts[5] = f"{prose(r, 60)} zembly, wattock {prose(r, 60)}"
    texts[6] = f"{prose(r, 60)} wattock zembly {prose(r, 60)}"
    texts[7] = f"{prose(r, 60)} {items[-1]} {prose(r, 60)}"
    got = {(x["doc_id"], x["item_id"]) for x in evalleak.leaks(docs(spark, texts), its).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 3), (2, 4), (2, 5), (2, 6), (3, 9), (4, 11), (5, 12), (7, 13)}


def test_leaks_with_changed_words(spark):
    """Each third word changed: no run of three words is left, but two thirds stand in order; three items that share a passage are all found."""
    r = random.Random(7)
    many = ["".join(r.choices("bcdfghklmnprstv", k=2)) + x + y for x in ("ado", "ire", "on", "ule", "ank", "est") for y in ("", "s", "ed", "ing") for _ in range(40)]
    prose = lambda r, n: " ".join(r.choices(many[:300], k=n // 2) + r.choices(many, k=n - n // 2))
    items = [prose(r, 90) for _ in range(5)]
    shared = prose(r, 60)
    items += [f"{shared} {prose(r, 30)}" for _ in range(3)]
    its = spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(items)], "item_id long, suite string, lang string, text string")
    texts = [prose(r, 150) for _ in range(80)]
    for d, i in ((2, 0), (3, 1)):
        changed = [r.choice(many) if k % 3 == d % 3 else w for k, w in enumerate(items[i].split())]
        texts[d] = f"{prose(r, 60)} {' '.join(changed)} {prose(r, 60)}"
    texts[4] = f"{prose(r, 60)} {shared} {prose(r, 60)}"
    want = {(2, 0), (3, 1), (4, 5), (4, 6), (4, 7)}
    assert {(x["doc_id"], x["item_id"]) for x in evalleak.leaks(docs(spark, texts), its).collect()} == want
    assert {(x["doc_id"], x["item_id"]) for x in evalleak.leaks(docs(spark, texts), its, at_once=3).collect()} == want


def test_best_window_of_all():
    r = random.Random(8)
    ws = r.sample(VOCAB, 60)
    items = evalleak.Items([(7, " ".join(ws))])
    read = evalleak.Reader()
    full = ws[::-1] * 2  # holds every word, in another order
    leak = ws[:30]
    text = read(" ".join(["zz"] * 40 + full + ["zz"] * 200 + leak + ["zz"] * 70))
    size = int(1.3 * 60) + evalleak.STEP
    want = max(evalleak.common_order(items.words[0].tolist(), text[lo : lo + size].tolist()) for lo in range(len(text) - size + 1)) / 60
    share, where = items.order(0, text)
    assert share == want == 0.5 and where <= 40 + 120 + 200 <= where + size - 30


def test_common_order():
    r = random.Random(0)
    for _ in range(50):
        a, b = ([r.randrange(6) for _ in range(r.randrange(1, 30))] for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert evalleak.common_order(a, b) == t[-1, -1]


def test_weight_in_order():
    r = random.Random(3)
    for _ in range(50):
        ws = [r.choice("abcdefgh") for _ in range(r.randrange(1, 30))]
        items = evalleak.Items([(1, " ".join(ws))])
        items.weigh(np.random.default_rng(r.randrange(1000)).random(evalleak.BUCKETS))
        text = evalleak.Reader()(" ".join(r.choice("abcdefghxyz") for _ in range(r.randrange(1, 60))))
        a, x = items.words[0], items.weight[0]
        t = np.zeros((len(a) + 1, len(text) + 1))
        for i in range(len(a)):
            for j in range(len(text)):
                t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + x[i] if a[i] == text[j] else 0)
        distinct = items.bags[0][0].tolist()
        at = np.array([distinct.index(w) for w in text.tolist() if w in distinct], np.int64)
        assert items.weighs(0, at, t[-1, -1] - 1e-9) and not items.weighs(0, at, t[-1, -1] + 1e-9)


def test_repeated_turns_of_phrase_cost_no_alignment_of_every_window(monkeypatch):
    r = random.Random(9)
    ws = r.sample(VOCAB, 60)
    items = evalleak.Items([(7, " ".join(ws))])
    idf = np.full(evalleak.BUCKETS, 0.1)
    idf[items.words[0][40:] & (evalleak.BUCKETS - 1)] = 1.0
    items.weigh(idf)
    turn = " zz ".join(ws[:40] + ws[:39:-1])  # the frequent words in order, the others turned round, and no runs
    text = evalleak.Reader()(" ".join([turn] * 20))
    done, aligned = [], evalleak.aligned
    monkeypatch.setattr(evalleak, "aligned", lambda *a: done.append(1) or aligned(*a))
    assert items.order(0, text, float(items.shared_runs(text)[0])) == (0.0, 0) and len(done) <= len(text) / 60


TEXT = "Please call Mrs. Elena Vintamont on +44 20 7946 0813 about this. Send the papers to emil+dock@highmere.mail.example.\nDeliver to 137 Pellbrook Street, Unit 8, Lambstad. Driver Hugo Karbtow, passport no. P5709486."


def test_mentions(spark):
    filler = "The crew stored 17 sacks of copper rings near Oskporto. "
    long_ = filler * 40 + TEXT + filler * 40
    df = docs(spark, [TEXT, None, "", " ", filler, long_, "\U0001f69a " + TEXT])
    got = {}
    for x in pii.mentions(df).collect():
        got.setdefault(x["doc_id"], set()).add((x["start_char"], x["pii_type"]))
    want = {(TEXT.index(s), k) for s, k in (("Elena", "name"), ("+44", "phone"), ("emil+", "email"), ("137", "address"), ("Hugo", "name"), ("P5709486", "id_number"))}
    assert got.keys() == {0, 5, 6}
    assert got[0] == want
    assert {(a + len(filler) * 40, k) for a, k in want} == got[5]
    assert {(a + 2, k) for a, k in want} == got[6]
    red = {x["doc_id"]: x for x in pii.redacted(df).collect()}
    assert "[NAME]" in red[0]["text"] and "Elena" not in red[0]["text"] and red[0]["text"].startswith("Please call Mrs. [NAME] on [PHONE] about this.")
    assert red[1]["text"] is None and red[4]["text"] == filler and red[4]["mentions"] == 0


def test_viterbi_is_best_path():
    rng = np.random.default_rng(0)
    for _ in range(20):
        e, t = rng.standard_normal((3, 5, 5)), rng.standard_normal((5, 5))
        t[[0, 1, 2, 0, 3, 4], [4, 4, 4, 2, 2, 2]] = -1e4  # a further character follows its own type only
        for row, path in zip(e, pii_model.decode(e, t)):
            score = lambda p: t[0][p[0]] + sum(row[i][p[i]] for i in range(5)) + sum(t[p[i]][p[i + 1]] for i in range(4)) + t[p[4]][0]
            best = max(score(p) for p in np.ndindex(5, 5, 5, 5, 5))
            assert score(path) == pytest.approx(best, abs=1e-4)


def test_tags_without_a_second_copy_of_the_scores():
    """Scores come as the search reads them; ties, what is forbidden and padding are as in the plain search."""
    w, rng = pii_model.load(), np.random.default_rng(4)
    x = np.zeros((3, 64), np.int16)
    for row, t in zip(x, (TEXT[:64], TEXT[50:90], "x")):
        row[: len(t)] = pii_model.classes(t)
    e = pii_model._emissions(w, x)
    assert e.shape == (64, pii_model.TAGS, 3) and e.flags.c_contiguous and np.array_equal(pii_model.emissions(w, x), e.transpose(2, 0, 1))
    trans = w["trans"].astype(np.float32)
    for e in (e, rng.integers(-2, 3, e.shape).astype(np.float32), np.zeros_like(e)):
        for scores, path in zip(e.transpose(2, 0, 1), pii_model._decode(e, trans)):
            s, back = trans[0] + scores[0], []
            for y in scores[1:]:
                all_ = s[:, None] + trans
                back.append(all_.argmax(axis=0))
                s = all_.max(axis=0) + y
            best = [(s + trans[:, 0]).argmax()]
            for b in back[::-1]:
                best.append(b[best[-1]])
            assert path.tolist() == best[::-1]


def test_training_learns(tmp_path, monkeypatch):
    from tidewright.llm import pii_train

    monkeypatch.setattr(pii_model, "FILE", tmp_path / "m.npz")
    monkeypatch.setattr(pii_train, "LENGTH", 128)
    texts = [f"The crew left {i} sacks. Tel: 020 7946 0{i:03d}. Nobody called." for i in range(120)]
    seen = []
    pii_train.train(texts, epochs=8, batch=8, workers=2, made=0.0, rate=2e-2, log=lambda s, *_, **__: seen.append(float(re.search(r"loss ([\d.]+)", s).group(1))))
    assert seen[-1] < seen[0] / 3 and (tmp_path / "m.npz").exists()


def test_gradients_are_right():
    from tidewright.llm import pii_train

    rng = np.random.default_rng(3)
    w = {k: v.astype(np.float64) for k, v in pii_train.start(rng).items()}
    x, y = rng.integers(1, 90, (3, 16)), np.zeros((3, 16), np.int8)
    y[0, 3], y[0, 4:7], y[1, 0], y[2, 12], y[2, 13:] = 1, 2, 3, 5, 6
    x[1, 12:] = 0
    w32 = {k: v.astype(np.float32) for k, v in w.items()}
    _, g = pii_train.gradients(w32, x, y)
    for k in ("u_f", "u_b", "out", "in1_f", "trans"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({**w32, k: w32[k].copy()} for _ in range(2))
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        slope = (pii_train.gradients(up, x, y)[0] - pii_train.gradients(down, x, y)[0]) / 2e-2
        assert slope == pytest.approx(g[k][i], rel=0.1, abs=1e-4)


def test_labels():
    assert [(TEXT[a:b], k) for a, b, k in pii_labels.spans(TEXT)][:2] == [("Elena Vintamont", "name"), ("+44 20 7946 0813", "phone")]
    assert pii_labels.spans("Vessel MV Elena Vintamont met Vintamont & Karbtow Freight.") == []


def test_public_tokenizer_sizes(spark):
    P = pytest.importorskip("public_tokenizers")
    got = {r["doc_id"]: r["tokens"] for r in packing.tokenizer_sizes(docs(spark, ["one two", None, ""]), str(P.path("byte_bpe_50k.json"))).collect()}
    assert got == {0: 2, 1: 0, 2: 0}
    assert F is not None


def test_sentences_from_elsewhere():
    """Hand-labelled sentences that neither the generator of training text nor the tables have; the README has the figures."""
    from pii_hand import labelled

    lines = labelled()
    got = pii.find([t for t, _ in lines], pii_model.load())
    a, b = {(i, s, k) for i, f in enumerate(got) for s, _, k in f}, {(i, s, k) for i, (_, f) in enumerate(lines) for s, k in f}
    assert len(a & b) >= 0.65 * len(b) and len(a & b) >= 0.8 * len(a)


def test_training_text_is_disjoint_from_the_tables():
    from tidewright.llm import pii_text

    m = pii_text.Maker(3)
    made = [m.fill(pii_text.document(m)) for _ in range(100)] + [m.fill(pii_text.template(TEXT)) for _ in range(20)]
    assert not any(re.search(rf"{pii_labels.SURNAME}|{pii_labels.STREET}|7946", t) for t, _ in made)
    assert sum(len(f) for _, f in made) > 200 and all(t[a:b].strip() for t, f in made for a, b, _ in f)
