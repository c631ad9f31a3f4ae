"""Packing, mixing and text statistics."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import mixing, packing, quality, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80), st.lists(st.integers(0, 63), max_size=9))
def test_pack(lengths, gaps):
    at = packing.pack(gaps, lengths, 64)
    load = np.bincount(at, lengths, minlength=len(gaps))
    assert (load <= np.array([*gaps, *[64] * (len(load) - len(gaps))])).all() and (at >= 0).all()
    assert (load[len(gaps):] > 0).all()
    # Only one new container can stay half empty.
    assert (load[len(gaps):] <= 32).sum() <= 1


def test_classes(spark):
    """Classes, counts and the two fills on random lengths, against a plain count."""
    lengths = np.random.default_rng(1).integers(1, 513, 6000).tolist()
    sizes = spark.createDataFrame(list(enumerate(lengths)), "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("small", 512)], "container_kind string, capacity_tokens int")
    rows = packing.packed(sizes, kinds, share=10**6).toPandas()
    assert ((rows["class"] * rows.tokens <= 512) & ((rows["class"] + 1) * rows.tokens > 512)).all()
    count = rows.groupby("class").size()
    own = rows.groupby(["class", "class_container"]).size().reset_index(name="n")
    assert (own.n <= own["class"]).all()
    for k, n in count.items():
        assert len(own[own["class"] == k]) == -(-n // k) and (own[own["class"] == k].n == k).sum() == n // k
    fixed = rows[rows.fixed].groupby("container_id")
    assert (fixed["class"].nunique() == 1).all() and (fixed.size() == fixed["class"].first()).all() and len(fixed) > 2000
    assert rows[rows.fixed]["class"].max() < rows[~rows.fixed]["class"].max()
    report = packing.packing_report(spark.createDataFrame(rows)).first()
    assert report.filled > 0.97 and report.filled_by_classes == pytest.approx(sum(lengths) / 512 / len(own), abs=1e-5)


def test_packing_checks_see_faults(spark):
    sizes = spark.createDataFrame([(i, 100 + 3 * i) for i in range(200)] + [(5, 7), (300, None)], "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("small", 256)], "container_kind string, capacity_tokens int")
    rows = packing.packed(sizes, kinds)
    assert tuple(packing.packing_checks(rows, sizes).first()) == ("small", 202, 0, 0, 0)
    assert packing.packing_checks(rows.where("doc_id <> 9"), sizes).where("lost > 0").count() == 1
    assert packing.packing_checks(rows.withColumn("container_id", F.lit("a")), sizes).first().overfull == 1


def test_packed(spark):
    sizes = spark.createDataFrame([(i, n, "x") for i, n in enumerate([100, 512, 1300, 0, None, 7, 412, 3, 100000])], "doc_id bigint, tokens bigint, piece string")
    kinds = spark.createDataFrame([("small", 512), ("odd", None)], "container_kind string, capacity_tokens int")
    rows = packing.packed(sizes, kinds).where("container_kind = 'small'").collect()
    for doc, n in enumerate([100, 512, 1300, 0, 0, 7, 412, 3, 100000]):
        own = sorted((r.start_token, r.tokens) for r in rows if r.doc_id == doc)
        assert sum(t for _, t in own) == n and own[0][0] == 0
        assert all(a[0] + a[1] == b[0] for a, b in zip(own, own[1:])) and len(own) == max(1, -(-n // 512))
    load = {}
    for r in rows:
        if r.container_id is not None:
            load[r.container_id] = load.get(r.container_id, 0) + r.tokens
    assert max(load.values()) <= 512
    assert sum(r.container_id is None for r in rows) == 2
    report = packing.packing_report(packing.packed(sizes, kinds)).first()
    assert report.tokens == 102334 and report.filled > 0.99
    assert packing.packed(sizes.where("doc_id < 0"), kinds).count() == 0


def test_mixture(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "big" if i % 3 else "small", int(v)) for i, v in enumerate(rng.integers(50, 900, 6000))] + [(9001, None, 5), (9002, "other", 5), (9003, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.5, 3), ("none", 0.2, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(sizes, targets).collect()
    total = sum(r.tokens * r.copies for r in got)
    small = sum(r.tokens * r.copies for r in got if r.source == "small")
    assert small / total == pytest.approx(0.5 / 0.8, abs=0.002)
    assert max(r.copies for r in got if r.source == "small") <= 3 and max(r.copies for r in got if r.source == "big") <= 1
    have = {s: sum(t for _, o, t in rows if o == s) for s in ("big", "small")}
    assert total == pytest.approx(min(have["big"] / 0.375, 3 * have["small"] / 0.625), rel=0.002)
    report = {r.source: r for r in mixing.mixture_report(mixing.mixed(sizes, targets), sizes, targets).collect()}
    assert report["none"].actual_share == 0 and report["small"].actual_share == pytest.approx(0.625, abs=0.002)
    checks = {r.source: r for r in mixing.mixture_checks(mixing.mixed(sizes, targets), sizes, targets).collect()}
    assert all(r.kept and r.unknown == 0 for r in checks.values()) and checks["small"].share == 0.625
    wrong = mixing.mixed(sizes, targets).withColumn("copies", F.when(F.col("source") == "small", 4).otherwise(F.col("copies")))
    assert not mixing.mixture_checks(wrong, sizes, targets).where("source = 'small'").first().kept
    fixed = mixing.mixed(sizes, targets, 100000).agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0]
    assert fixed == pytest.approx(100000, rel=0.01)
    assert mixing.mixed(sizes.where("doc_id < 0"), targets).count() == 0


def test_longer_documents_are_likelier(spark):
    rows = [(i, "a", 100 if i % 2 else 900) for i in range(4000)]
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint"), targets, 400000).groupBy("tokens").count().collect()
    n = {r.tokens: r["count"] for r in got}
    assert 2 < n[900] / n[100] < 4.5


@pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")
def test_tokens(spark):
    assert tokens.count_tokens("Hello world") == 2
    docs = spark.createDataFrame([(1, "Hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.tokens for r in tokens.token_counts(docs).collect()} == {1: 2, 2: 0, 3: 0}


PROSE = "After the rain, the barn often watches the roof of the harbour. There is a muddy path behind the stove, and it follows the river. We think that every window keeps a quiet garden."
CASES = {
    "prose": [PROSE, PROSE.lower(), "Home\nNews\nContact\n" + PROSE + "\n© 2020 a.example", "Wir haben auch die Laterne gesehen. Nach dem Regen trägt der Ofen die Brücke, und sie ist nicht so alt wie das Dach.".encode().decode("latin-1"),
              "Se il ponte è alto, allora nessuno porta la stufa. C’è un prato vuoto dietro la tasca, e non è più di un giardino per questo porto.", "– " + PROSE + "\n– " + PROSE, "\n".join(PROSE[i:i + 60] for i in range(0, len(PROSE), 60))],
    "list": ["\n".join(f"{i}. {w}, barn" for i, w in enumerate("roof path tile mill door shed pond gate".split())), "\n".join(f"• how to use the {w} roof" for w in "old new red dry wet low".split()), "Home | News | Help\n" + "\n".join(f"{w} ({i})" for i, w in enumerate("Roof Path Tile Mill Door Shed".split()))],
    "table": ["Roof\tPath\tTile\n" + "\n".join(f"TU-{i}\t{i * 7}.5\tbarn" for i in range(9)), "\n".join(f"| AB-{i} | what is in the roof | {i} |" for i in range(9)), "\n".join(f"AB-{i};{i}.4;2020-01-0{i}" for i in range(9)), "\n".join(f"AB-{i}      {i}.4      2020-01-0{i}" for i in range(9))],
    "junk": ["Mkzxv qwpfj zzkqv xjrwq. Vbnmk lkjhg qpwoe rtyzx, cvbqk wzxpl jhgfq dmwnx vkqzj." * 2, "var a=function(b,c){return d.e(42)||\"f\"};\nif(!a.b){c[\"d\"]=e+5;}\ntry{a.push({b:\"c\",t:9})}catch(e){}", "If the roof is old, then nobody carries the barn. " * 20,
             "aGVsbG8gd29ybGQgdGhpcyBpcyBlbmNvZGVkIGRhdGEgYWJjZGVmZ2hpamtsbW5vcHFyc3R1dnd4eXo", " ".join(["слово", "другое", "ещё", "мост", "река"] * 9).encode().decode("latin-1"), "%C3%A4\\x41\\x7f%20%2F\\x09" * 9],
}
COMMON = {"en": set("the a of and to in is it was that for with on not be are this they you we if or can when what how there after more then nobody every".split()), "de": set("der die das und in zu den ist nicht mit von es sie er ein eine auf für auch so wie wenn dann nach man wir".split())}


BOILERPLATE = ["home", "news", "contact", "help", "© 0000 @"]


@pytest.mark.parametrize("kind", list(CASES))
def test_kinds(kind):
    """With the profiles as they start, before any is fitted."""
    profiles = quality.Profiles(COMMON | {"it": set("se il è allora nessuno la c’è un dietro e non più di per questo".split())}, BOILERPLATE)
    for text in CASES[kind]:
        assert quality.describe(text, profiles, "a.example")["kind"] == kind, text[:60]


def test_prose_of_other_scripts():
    profiles = quality.Profiles(COMMON)
    for text in ("Если крыша старая, то никто не чинит сарай. За печью есть грязная дорога, и она ведёт к реке. Мы думаем, что каждое окно хранит тихий сад, и это видно утром.", "屋根が古いと、誰も納屋を直しません。ストーブの後ろには泥だらけの道があり、川に続いています。どの窓も静かな庭を守っていると思います。朝になるとそれが見えます。"):
        assert quality.describe(text, profiles)["kind"] == "prose"


def test_boilerplate(spark):
    """What a language's documents repeat at their edges is learned; entries of lists are not."""
    rng = np.random.default_rng(5)
    menu, nouns = "Home News Help Login Map".split(), [f"{w}{e}" for w in "roof path tile mill door shed pond gate barn loft".split() for e in "abcdefghij"]
    rows = []
    for i in range(200):
        top = "\n".join(rng.choice(menu, 3, replace=False)) if i % 2 else " | ".join(rng.choice(menu, 4, replace=False))
        body = "\n".join(rng.choice(nouns, 25)).title() if i % 5 == 0 else " ".join(f"We think that every {a} keeps a {b} behind the {c}." for a, b, c in rng.choice(nouns, (6, 3)))
        rows.append((i, f"{top}\n{body}\n© 20{i % 10:02d} h{i % 7}.example", "en" if i % 9 else None, f"h{i % 7}.example"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string")
    found = quality.boilerplate_units(docs)
    assert set(found) >= {m.lower() for m in menu} | {"© 0000 @"} and not set(found) & set(nouns)
    lines = quality.main_lines(quality.split_lines(rows[1][1]), "h1.example", frozenset(found))
    assert len(lines) == 1 and lines[0].startswith("We think")


def test_fitted_profiles_move():
    start = quality.Profiles(COMMON)
    seen = start.table[0] * 0.9
    seen[quality.SPAN["columns"][0]] = 0.1
    fit = start.fitted(np.array([seen] * 20))
    assert fit.distances(seen)[0] < start.distances(seen)[0] and np.allclose(fit.table[5:], start.table[5:])
    assert start.fitted(np.zeros((0, quality.WIDTH))).table.shape == start.table.shape


def test_fit_uses_all_documents(spark):
    """A rare language is learned, and profiles move to the mean of every document, not of some."""
    rare = "kas on see maja ja tema tuli".split()
    rows = [(i, f"The {'abcdefghij'[i % 10] * 3} barn is {'old' * (i % 7)} and it follows the river of {i * i}.", "en", None) for i in range(9000)]
    rows += [(9000 + i, " ".join(rare) + f" {'xyzuvw'[i % 6] * 4}.", "et", None) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, host string")
    words = spark.createDataFrame([("en", w) for w in COMMON["en"]], "lang string, word string")
    fit = quality.fit_profiles(docs, words)
    assert fit.common["et"] == set(rare) and set(fit.common) == {"en", "et"}
    start = quality.Profiles(fit.common, fit.boilerplate)
    seen = np.array([d["shares"] for _, t, _, h in rows if not (d := quality.read_text(t, start, h))["empty"]])
    assert len(seen) == len(rows) and np.allclose(fit.table, start.fitted(seen).table, atol=1e-10)
    again = quality.fit_profiles(docs.repartition(3, "text"), words)
    assert (again.table == fit.table).all()


def test_divergence():
    assert quality.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)
    assert quality.divergence(np.array([2.0, 2]), np.array([5.0, 5])) == pytest.approx(0)
    profiles = quality.Profiles(COMMON)
    p, q = profiles.table[0], profiles.table[4]
    by_block = sum(w * quality.divergence(p[slice(*quality.SPAN[b])], q[slice(*quality.SPAN[b])]) for b, (_, w) in quality.BLOCKS.items())
    assert profiles.distances(p)[4] == pytest.approx(by_block)


def test_statistics(spark):
    docs = spark.createDataFrame([(1, PROSE, "x", "en", "h"), (2, None, "x", None, None), (3, "", "x", "en", None), (4, "\n \n", "x", "en", "h"), (5, PROSE * 3000, "x", "en", "h"), (1, PROSE, "x", "en", "h")], "doc_id bigint, text string, kind string, lang string, host string")
    words = spark.createDataFrame([("en", w) for w in COMMON["en"]] + [(None, "x"), ("en", None)], "lang string, word string")
    got = quality.text_statistics(docs, words, quality.Profiles(COMMON)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].kind == "prose" and by[1].n_words == 34 and by[1].lines_punctuated == 1 and by[1].language == "en"
    assert by[2].kind is None and by[3].kind == by[4].kind == "empty" and by[5].kind == "junk"
    assert quality.structured_texts(docs, words, quality.Profiles(COMMON)).count() == 1
    assert quality.text_statistics(docs, words).count() == 6 and quality.structured_texts(docs.where("doc_id > 9"), words.where("false")).count() == 0
    counts = {r.doc_id: r for r in quality.text_counts(docs, words).collect()}
    assert counts[1].n_words == 34 and counts[2].n_words is None and counts[3].mean_word_length is None and 0.3 < counts[1].common_share < 0.7
