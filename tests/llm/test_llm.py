"""Training-data operators on small fixtures, against brute force."""

import itertools
import os
import re
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textquarry.llm import distinctive_terms as dt, entity_match as em, mixing, near_duplicates as nd, packing, residue, term_frequency as tf, truncation
from textquarry.llm.queries import COMMON, queries
from textquarry.llm.text import letter_terms, list_values
from textquarry.session import ensure_checkpoint_dir

WORDS = ["".join("abcdefghij"[int(d)] for d in f"{i:03d}") + "word" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS, n))


# --------------------------------------------------------- near duplicates


def texts(spark, rows):
    return spark.createDataFrame(rows, "campo string, id long, text string, extra int, blocks string")


def brute_pairs(rows, threshold, width, least):
    sets = {}
    for campo, i, t, *_ in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= least:
            sets[campo, i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    out = set()
    for (a, x), (b, y) in itertools.combinations(sets.items(), 2):
        if a[0] == b[0] and a[1] != b[1] and len(x & y) >= threshold * len(x | y):
            out.add((a[0], min(a[1], b[1]), max(a[1], b[1])))
    return out


def near_rows():
    rng = np.random.default_rng(1)
    rows, base = [], [sentence(rng, int(n)) for n in rng.integers(30, 200, 40)]
    for i, t in enumerate(base):
        rows.append(("r", i, t, 0, ""))
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append(("r", 100 + i, " ".join(w), 0, ""))
    rows += [("r", 200 + i, base[0].upper(), 0, "") for i in range(30)]  # a group of copies
    rows += [("d", 1, base[0], 0, ""), ("r", 900, None, 0, ""), ("r", 901, "", 0, ""), ("r", 902, "too short", 0, ""), ("r", 903, sentence(rng, 20_000), 0, "")]
    return rows + rows[:2]  # repeated rows


@pytest.mark.parametrize("chunk", [2000, 7])
def test_near_duplicate_pairs(spark, chunk):
    rows = near_rows()
    got = [tuple(r) for r in nd.near_duplicate_pairs(texts(spark, rows), threshold=0.6, chunk=chunk).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 0.6, 3, 25)


def test_near_duplicates_keep_little_on_disk(spark, monkeypatch):
    """What lies on disk between the steps, tables and shuffle files, is less
    than fingerprints of whole slots and kept shingle sets would take."""
    rng = np.random.default_rng(5)
    rows = [("r", i, sentence(rng, 300), 0, "") for i in range(1000)]
    rows += [("r", 2000 + i, t.replace("word", "words", 1), 0, "") for _, i, t, *_ in rows[:100]]

    def held():
        local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()
        dirs = [ensure_checkpoint_dir(spark).removeprefix("file:"), *[d.getPath() for d in local]]
        files = [os.path.join(at, f) for d in dirs for at, _, names in os.walk(d) for f in names]
        return sum(os.path.getsize(f) for f in files if "cut-" in f or os.path.basename(f).startswith("shuffle_"))

    real, most, before = nd.cut, [], held()

    def watched(df, **how):
        out = real(df, **how)
        most.append(held() - before)
        return out

    monkeypatch.setattr(nd, "cut", watched)
    pairs = {tuple(r) for r in nd.near_duplicate_pairs(texts(spark, rows), threshold=0.6).collect()}
    assert pairs == {("r", i, 2000 + i) for i in range(100)}
    assert max(most) < 900 * len(rows)


def test_texts_with_a_phrase_in_common_make_no_table_of_pairs(spark):
    """Texts that share blocks but lie beyond the Hamming limit: their pairs,
    some 100 000 here, are at no time rows of a shuffle."""
    rng = np.random.default_rng(7)
    phrase = sentence(rng, 36)
    rows = [("r", i, f"{phrase} {sentence(rng, 36)}", 0, "") for i in range(700)]
    local = [d.getPath() for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirs()]

    def held():
        total = 0
        for f in (os.path.join(at, f) for d in local for at, _, names in os.walk(d) for f in names if f.startswith("shuffle_")):
            try:
                total += os.path.getsize(f)
            except OSError:  # gone meanwhile
                pass
        return total

    before, most, over = held(), [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            most[0] = max(most[0], held() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        pairs = {tuple(r) for r in nd.near_duplicate_pairs(texts(spark, rows), threshold=0.6).collect()}
    finally:
        over.set()
        watcher.join()
    assert pairs == brute_pairs(rows, 0.6, 3, 25)
    assert most[0] < 1_500_000


def test_near_duplicate_classes(spark):
    rows = near_rows()
    got = {(r.campo, r.id): (r.class_id, r.n_links) for r in nd.near_duplicate_classes(texts(spark, rows), threshold=0.8).collect()}
    assert {got["r", 200 + i][0] for i in range(30)} == {0} and got["r", 0][0] == 0
    pairs = brute_pairs(rows, 0.8, 5, 5)
    for campo, a, b in pairs:
        assert got[campo, a][0] == got[campo, b][0]
    assert len({c for (f, _), (c, _) in got.items() if f == "d"}) == 1
    assert got.keys() == {(f, i) for f, i, t, *_ in rows if t is not None}


def test_short_texts_have_classes(spark):
    rows = [("r", 1, "Too short", 0, ""), ("r", 2, "too, SHORT!", 0, ""), ("r", 3, "other", 0, ""), ("r", 4, "", 0, ""), ("r", 5, None, 0, ""), ("d", 6, "too short", 0, "")]
    got = {r.id: r.class_id for r in nd.near_duplicate_classes(texts(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 6: 6}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([("r", i, i + 1) for i in range(60)] + [("r", 100, 101)], "campo string, a long, b long")
    assert {r.id: r.class_id for r in nd.components(edges).collect()} == {i: 0 for i in range(61)} | {100: 100, 101: 100}


# ------------------------------------------------------------------ residue

RESIDUE = [
    "{{ summary }}", "Welcome to <%= product %>", "A tool with ${SHORT_DESC} layout", "[page_title] | Home", ":tagline:", "__PAGE_TITLE__", "%body%",
    "Lorem ipsum dolor sit amet magna", "asdf qwer zxcv", "text text text", "undefined", "TBD", "<h1>Page not found. Go back to the start page.</h1>",
    "* ACESSO NEGADO: MUITAS SOLICITAÇÕES VINDAS DA SUA REDE", "please turn on javascript to view this page (#a1b2)", "Error 404: the page you asked for could not be shown",
    "A long and real description. Please enable JavaScript to continue. More of it.", "Insert a short description of the project", "projeto - %motivo%",
]
REAL = [
    "A tool that expands ${VAR} references before deployment", "Template client that fills {{ name }} marks at build time", "Syntax tree of <% %> and [placeholders] for Go",
    "Lorem ipsum generator with 24 dictionaries", 'Explains each "page not found" in the access log', "Detects visitors with JavaScript disabled", "TODO list manager",
    "Error 40 decoder for devices", "Not found? A crawler that searches again", "projeto; página sobre templates {{ }}", "erro_rede: try again later, HTTP 503 duas vezes",
    "erro_http: servidor respondeu 'page not found' (40 ms)", "ok [10]", "projeto (5 links)", "<p>A modern <b>monitor</b></p>", "", "   ", None,
]


def values(spark, rows):
    return spark.createDataFrame([("t", str(i), v, "x") for i, v in enumerate(rows)], "tabela string, chave string, valor string, term string")


def test_residue(spark):
    rows = RESIDUE + REAL
    got = {int(r.chave) for r in residue.template_residue(values(spark, rows)).collect()}
    assert got == set(range(len(RESIDUE))), [rows[i] for i in got ^ set(range(len(RESIDUE)))]


def test_residue_by_given_exemplars(spark):
    """The labelled table is a parameter; what it does not hold is not found."""
    rows = [("projeto vazio por enquanto", 1), ("This space is vacant for now, sorry", 1), ("<p>This space is vacant for now</p>", 1), ("A vacant space planner for parking lots", 0), ("undefined", 0)]
    table = [("vago", "whole", "projeto vazio por enquanto"), ("vago", "part", "this space is vacant for now")]
    got = {int(r.chave): r.rotulo for r in residue.template_residue(values(spark, [v for v, _ in rows]), table).collect()}
    assert got == {i: "vago" for i, (_, case) in enumerate(rows) if case}


def test_residue_repeats_and_long_texts(spark):
    df = spark.createDataFrame([("v", "u", "undefined")] * 3 + [("v", "u", "ok"), ("v", "l", "real words " * 20_000 + "please turn on javascript to view this page"), ("v", "m", "the page " * 20_000)] + [("v", "w", "ok [10]")] * 4, "tabela string, chave string, valor string")
    assert sorted(r.chave for r in residue.template_residue(df).collect()) == ["l", "u"]
    assert residue.template_residue(df.limit(0)).count() == 0


# ---------------------------------------------------------- entity matching


def entity_rows():
    rng = np.random.default_rng(4)
    kinds, objects, feats = [f"kind{c}" for c in "abcdefghij"], [f"object{c}" for c in "klmnopqrst"], [f"feat{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    letters = list("abcdefghijklmnopqrstuvwxyz")
    rows = []
    for i in range(80):
        name = "".join(rng.choice(letters, 9))
        what = f"{rng.choice(kinds)} {rng.choice(objects)}"
        f = list(rng.choice(feats, 3, replace=False))
        typo = name if i % 4 else name[:3] + name[4] + name[3] + name[5:]
        rows.append((i, "github", name, f"Tool for {what} with {f[0]} and {f[1]}", "Go", "MIT license", "x"))
        rows.append((1000 + i, "sourceforge", typo.title(), f"This project handles {what}, with {f[1]}, {f[0]} and {f[2]} for everybody", "Go" if i % 3 else None, "MIT License", "x"))
        # the name again, for something else
        other = f"{rng.choice(kinds)} {rng.choice(objects)}"
        rows.append((2000 + i, "sourceforge", name, f"Unrelated program about {other} offering {rng.choice(feats)} only", "C", "BSD License", "x"))
    return rows + [(5000, "github", None, "text", None, None, "x"), (5001, "sourceforge", "name", None, None, None, "x"), (5002, "github", "", "", None, None, "x")]


def test_entity_matching(spark):
    table = spark.createDataFrame(entity_rows(), "id long, site string, nome string, descricao string, linguagem string, licenca string, keys string")
    got = {(r.a, r.b): r.confianca for r in em.match_entities(table).collect()}
    want = {(i, 1000 + i) for i in range(80)}
    found = set(got)
    assert len(found & want) >= 0.9 * len(want), len(found & want)
    assert len(found & want) >= 0.9 * len(found), len(found)
    assert all(0.5 <= c <= 1 for c in got.values())


def test_entity_matching_under_another_name(spark):
    """Projects with other names: a shared rare word, initials, a former name."""
    rng = np.random.default_rng(7)
    kinds, objects, feats = [f"kind{c}" for c in "abcdefghij"], [f"object{c}" for c in "klmnopqrst"], [f"feat{a}{b}" for a in "abcdef" for b in "uvwxyz"]
    word = lambda n: "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), n))
    rows, ways = [], ("rare", "init", "named")
    for i in range(30):
        what, f = f"{rng.choice(kinds)} {rng.choice(objects)}", list(rng.choice(feats, 3, replace=False))
        one, two, other, rare = word(8), word(7), word(9).title(), word(10)
        here, there = {"rare": (f" Speaks {rare}.", f" It implements the {rare} protocol."), "init": ("", ""), "named": ("", f" Moved from {one.title()} {two.title()}.")}[ways[i % 3]]
        name = (one[0] + two[0]).upper() if ways[i % 3] == "init" else other
        rows.append((6000 + i, "github", f"{one}-{two}", f"Tool for {what} with {f[0]} {f[1]} {f[2]}.{here}", "Go", "MIT license", ""))
        rows.append((7000 + i, "sourceforge", name, f"Handles {what}, featuring {f[0]} {f[1]} {f[2]} for everybody.{there}", "Go", "MIT License", ""))
    table = spark.createDataFrame(entity_rows() + rows, "id long, site string, nome string, descricao string, linguagem string, licenca string, keys string")
    got = {(r.a, r.b) for r in em.match_entities(table).collect()}
    for k, way in enumerate(ways):
        own = {(6000 + i, 7000 + i) for i in range(30) if i % 3 == k}
        assert len(got & own) >= 8, (way, len(got & own))
    wrong = {(a, b) for a, b in got if a >= 6000 and b != a + 1000}
    assert len(wrong) <= 3, wrong


def test_entity_matching_without_one_site(spark):
    table = spark.createDataFrame([r[:6] for r in entity_rows() if r[1] == "github"], "id long, site string, nome string, descricao string, linguagem string, licenca string")
    assert em.match_entities(table).count() == 0
    assert em.match_entities(table.limit(0)).count() == 0


def test_entity_matching_of_repeated_pages(spark):
    """A page collected again is one record until the end, then every row counts."""
    rows = [r[:6] for r in entity_rows()]
    again = [(r[0] + 10_000 * k, *r[1:]) for r in rows if r[0] == 5 or r[0] == 1005 for k in range(1, 40)]
    table = spark.createDataFrame(rows + again, "id long, site string, nome string, descricao string, linguagem string, licenca string")
    reps, members = em.distinct_records(em.cut(em.records(table)))
    assert reps.count() == len({r[1:4] for r in rows if r[2] and r[3]}) and members.count() == len(rows) + len(again) - 3
    got = {(r.a, r.b) for r in em.match_entities(table).collect()}
    assert {(5 + 10_000 * i, 1005 + 10_000 * j) for i in range(40) for j in range(40)} <= got


def test_blocking_against_all_pairs(spark):
    """Of the pairs that would match among all of both sites, nine of ten and more are candidates."""
    folder = os.environ.get("TEXTQUARRY_MEDIUM", "/root/testdata/sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    reps, _ = em.distinct_records(em.cut(em.records(spark.read.parquet(f"{folder}/projetos.parquet"))))
    full, pairs, _ = em.candidates(reps, "github", "sourceforge")
    site = lambda name, end: reps.where(F.col("site") == name).join(full.select("id"), "id", "left_semi").select(F.col("id").alias(end))
    scored = em.score_pairs(full, site("github", "a").crossJoin(site("sourceforge", "b")))
    model = em.calibrate(scored)
    every = {(r.a, r.b) for r in em.confidences(scored, model).where("confianca >= 0.5").collect()}
    found = {(r.a, r.b) for r in pairs.collect()}
    assert len(every) > 20 and len(every & found) >= 0.95 * len(every)


def test_a_name_of_a_third_of_all_rows_fills_no_block(spark, monkeypatch):
    rows = [r[:6] for r in entity_rows()]
    kinds = ["github", "sourceforge"]
    rng = np.random.default_rng(6)
    words = [f"term{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    rows += [(20_000 + i, kinds[i % 2], "same-name", " ".join(rng.choice(words, 9)), "Go", "MIT License") for i in range(600)]
    table = spark.createDataFrame(rows, "id long, site string, nome string, descricao string, linguagem string, licenca string")
    reps, _ = em.distinct_records(em.cut(em.records(table)))
    met = lambda: em.candidates(reps, "github", "sourceforge")[1].where("a >= 20000 and b >= 20000").count()
    with_more = met()
    monkeypatch.setattr(em, "MORE", 0)
    assert with_more < met() / 2


def test_calibration_by_chance_labels():
    """Agreement by chance among many pairs that are no match moves no cut."""
    rng = np.random.default_rng(3)
    for n in (300, 20_000):
        x = np.concatenate([rng.normal(0.8, 0.1, (300, 2)), rng.normal(0.2, 0.15, (n, 2))])
        truth = np.concatenate([np.ones(300), np.zeros(n)])
        y = np.where(truth > 0, rng.random(n + 300) < 0.95, rng.random(n + 300) < 0.03).astype(float)
        model = em.fit_calibration(x, y, x.prod(axis=1), products=[(0, 1)])
        assert ((model.confidence(x) > 0.5) == (truth > 0)).mean() > 0.99, n
        assert abs(model.chance - 0.03) < 0.03 and model.missed < 0.1


def test_walks_reach_a_record_once_a_step(spark):
    """However frequent a token is, no record receives all its walks."""
    rows = [(i, [7, i], [1.0, 1.0]) for i in range(500)]
    profile = spark.createDataFrame(rows, "id long, sample array<long>, w array<double>")
    ends = em.walks(profile, hops=1).groupBy(F.slice("walk", 4, 2).alias("to")).count()
    assert ends.agg(F.max("count")).first()[0] == 1 and ends.count() > 450


# -------------------------------------------------------- term statistics


def term_table(spark):
    rng = np.random.default_rng(3)
    rows = [(i, "common " * 3 + " ".join(rng.choice(WORDS[:50], 30)) + (" özel özel özel özel" if i in (3, 4) else ""), ["A ", "a", None, " "] if i % 2 else [], None) for i in range(60)]
    rows += [(60, None, None, None), (61, "", [], []), (62, "ab 12", ["x"], ["Z"]), (63, "long " * 50_000, None, None)]
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, readme string, topicos array<string>, categorias array<string>, termo int")


def field_terms(df):
    return tf.field_terms(df, {"readme": letter_terms(F.col("readme")), "topicos": list_values(F.col("topicos")), "categorias": list_values(F.col("categorias"))})


def brute_terms(df):
    out = {}
    for r in df.collect():
        out["readme", r.id] = Counter(re.findall(r"[^\W\d_]{3,}", (r.readme or "").lower()))
        for c in ("topicos", "categorias"):
            out[c, r.id] = Counter(v.strip().lower() for v in (r[c] or []) if v and v.strip())
    return {k: v for k, v in out.items() if v}


def test_frequencies(spark):
    df = term_table(spark)
    want = brute_terms(df)
    occ, rec, rows = Counter(), Counter(), Counter()
    for (c, _), counts in want.items():
        rows[c] += 1
        for t, n in counts.items():
            occ[c, t] += n
            rec[c, t] += 1
    got = {(r.campo, r.termo): (r.ocorrencias, r.registros, r.linhas, r.marca) for r in tf.marked_frequencies(field_terms(df), COMMON).collect()}
    mark = lambda c, t: "rara" if rec[c, t] == 1 else "comum" if rec[c, t] >= COMMON[c] * rows[c] else None
    assert got == {(c, t): (occ[c, t], rec[c, t], rows[c], mark(c, t)) for c, t in occ}
    assert tf.marked_frequencies(field_terms(df.limit(0)), COMMON).count() == 0


@pytest.mark.parametrize("heavy", [2000, 10])
def test_distinctive_terms(spark, heavy):
    df = term_table(spark)
    want = brute_terms(df)
    cf, df_ = Counter(), Counter()
    for (c, _), counts in want.items():
        for t, n in counts.items():
            cf[c, t] += n
            df_[c, t] += 1
    total = Counter()
    for (c, _), n in cf.items():
        total[c] += n
    got = {(r.campo, r.id, r.termo): (r.tf, r.df, r.score) for r in dt.distinctive_terms(field_terms(df), heavy=heavy).collect()}
    assert set(got) == {(c, i, t) for (c, i), ts in want.items() for t in ts}
    for (c, i), ts in want.items():
        names = sorted(ts)
        p = dt.parsimonious(np.array([ts[t] for t in names], float), np.array([cf[c, t] / total[c] for t in names]))
        for t, v in zip(names, p):
            assert got[c, i, t][:2] == (ts[t], df_[c, t]) and abs(got[c, i, t][2] - v) < 1e-4
    own = {t: got["readme", 3, t][2] for t in want["readme", 3]}
    assert own["common"] < own["özel"]


# ------------------------------------------------------------------ packing


@pytest.mark.parametrize("slots", [1, 8])
def test_packing(spark, slots):
    rng = np.random.default_rng(5)
    sizes = [int(n) for n in rng.integers(1, 300, 500)] + [1] * 300 + [256] * 20 + [1000, 2560]
    items = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, tokens long")
    caps = [("a", 256), ("b", 100)]
    rows = packing.harmonic_packing(items, caps, slots=slots).collect()
    for name, cap in caps:
        own = [r for r in rows if r.recipiente == name]
        boxes, per = Counter(), Counter()
        for r in own:
            boxes[r.container] += r.tokens
            per[r.doc_id] += r.tokens
        assert max(boxes.values()) <= cap
        assert per == Counter(dict(enumerate(sizes)))
        assert all(len([r for r in own if r.doc_id == i]) == -(-n // cap) for i, n in enumerate(sizes))
    unused = {r.recipiente: r.taxa_livre for r in packing.unused_space(packing.harmonic_packing(items, caps)).collect()}
    assert all(0 <= v < 0.4 for v in unused.values())
    assert packing.harmonic_packing(items.limit(0), caps).count() == 0 and packing.harmonic_packing(items, []).count() == 0


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "a" * 50_000), (1, "hello world")], "doc_id long, text string")
    assert {r.doc_id: r.tokens for r in packing.sized(df).collect()}.keys() == {1, 4}


# ------------------------------------------------------------------- mixing


def mix(spark, counts, targets, **options):
    rows, n = [], 0
    for (source, lang), sizes in counts.items():
        for size in sizes:
            rows.append((n, source, lang, size))
            n += 1
    sized = spark.createDataFrame(rows, "doc_id long, source string, idioma string, tokens long")
    goal = spark.createDataFrame(targets, "mistura string, source string, peso_alvo double, max_repeticoes int")
    budgets, shares = mixing.plan_mixtures(sized, goal, **options)
    chosen = mixing.mix_sources(sized, budgets)
    return chosen.collect(), {(r.mistura, r.source): r for r in mixing.actual_shares(chosen, shares).collect()}


def test_mixture_on_target(spark):
    counts = {("a", "en"): [10] * 500, ("a", "pt"): [10] * 100, ("b", "en"): [7] * 60, ("c", "en"): [5] * 30, (None, "en"): [9] * 5}
    targets = [("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 3), ("n", "a", 0.9, 1), ("n", "zero", 0.1, 5)]
    chosen, shares = mix(spark, counts, targets)
    for s, w, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)):
        assert abs(shares["m", s].parte - w) < 0.02
        assert max(r.repeticoes for r in chosen if r.mistura == "m" and r.source == s) <= cap
    assert shares["n", "zero"].tokens == 0 and shares["n", "a"].parte == 1
    assert len({(r.mistura, r.doc_id) for r in chosen}) == len(chosen)


def test_shortage_goes_to_siblings(spark):
    counts = {("x1", "en"): [10] * 10, ("x2", "en"): [10] * 1000, ("y", "en"): [10] * 1000}
    targets = [("m", "x1", 0.25, 2), ("m", "x2", 0.25, 1), ("m", "y", 0.5, 1)]
    _, shares = mix(spark, counts, targets, total_tokens={"m": 4000}, domains={"x1": "x", "x2": "x"})
    assert shares["m", "x1"].tokens == 200  # its cap
    assert abs(shares["m", "x2"].tokens - 1800) <= 10 and abs(shares["m", "y"].tokens - 2000) <= 10
    assert mix(spark, counts, [("m", "x1", 1.0, 0)])[1]["m", "x1"].tokens == 0


def test_a_source_without_documents_gives_to_its_siblings(spark):
    counts = {("forum", "en"): [10] * 20_000, ("wiki", "en"): [10] * 20_000, ("listagem", "pt"): [10] * 20_000}
    targets = [("m", "forum", 0.2, 1), ("m", "chat", 0.3, 1), ("m", "wiki", 0.25, 1), ("m", "listagem", 0.25, 1)]
    _, shares = mix(spark, counts, targets, total_tokens={"m": 100_000}, domains={"forum": "c", "chat": "c", "wiki": "p", "listagem": "p"})
    assert [abs(shares["m", s].tokens - n) <= 10 for s, n in (("forum", 50_000), ("chat", 0), ("wiki", 25_000), ("listagem", 25_000))] == [True] * 4


# --------------------------------------------------------------- truncation


def test_truncation(spark):
    rng = np.random.default_rng(8)
    say = lambda n: ". ".join(sentence(rng, 7).capitalize() for _ in range(n)) + "."
    rows, cut = [], set()
    for i in range(1500):
        t = say(int(rng.integers(1, 14)))
        if i % 9 == 0:
            t += "\n\nThanks"
        if len(t) > 300:
            t = t[:300]
            if not t.endswith("."):
                cut.add(i)
        rows.append((i, t, "src"))
    rows += [(3000, None, "src"), (3001, "  \n ", "src"), (3002, "A real end.\n\n```\nrun x", "other"), (3003, "An end of its own...\n\nMore [...]", None), (3004, "The list:\n\n- one for all", "other"), (3005, say(30_000), "other")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, source string, unit int")
    got = {r.doc_id: r for r in truncation.truncated_texts(df).collect()}
    assert 3000 not in got and 3001 not in got
    found = {i for i in range(1500) if got[i].is_cut}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut)
    assert got[3002].is_cut and got[3003].is_cut and not got[3005].is_cut
    limits = [(r.unit, r.limit) for r in truncation.length_limits(df).collect() if r.source == "src"]
    assert ("chars", 300) in limits
    assert truncation.truncated_texts(df.limit(0)).count() == 0
    rates = {r.source: r.cortados for r in truncation.truncation_rates(df).collect()}
    assert rates["src"] == len(found)


def test_truncation_statistics_count_a_text_once(spark):
    rng = np.random.default_rng(9)
    rows = [(i, sentence(rng, int(rng.integers(5, 60))).capitalize() + ".", "src") for i in range(200)]
    copied = "A complete text with a list of things to know.\n\n- " + sentence(rng, 6)
    rows += [(1000 + i, copied, "src") for i in range(300)]
    # a closing line, and a copied text with a line that begins like it
    rows += [(2000 + i, sentence(rng, 9).capitalize() + ".\n\nThanks to all here", "src") for i in range(30)]
    rows += [(3000 + i, "Thanks to all here and to everybody who helped.\n\nThe real end.", "src") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    limits = {(r.unit, r.limit) for r in truncation.length_limits(df).collect()}
    assert ("chars", len(copied)) not in limits
    got = {r.doc_id: r.is_cut for r in truncation.truncated_texts(df).collect()}
    assert len(got) == len(rows)
    assert not any(got[2000 + i] for i in range(30))


def test_truncation_by_the_posterior(spark):
    """A heading or a list item may well end a text; at a limit it is a cut."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(1, 12))))
    say = lambda n: " ".join(" ".join(word() for _ in range(int(rng.integers(3, 12)))).capitalize() + "." for _ in range(n))
    rows, at_limit, away = [], set(), set()
    for i in range(900):
        t = say(int(rng.integers(2, 30)))
        rows.append((i, t if len(t) <= 700 else t[:700], "src"))
    for i in range(900, 960):
        end = f"\n\n## {sentence(rng, 3)}" if i % 3 else f"\n\n- {sentence(rng, 3)} those\n- {sentence(rng, 3)} those"
        t = say(30)[: 700 - len(end)].rstrip() if i % 2 else say(int(rng.integers(2, 8)))
        t = t + "." * (700 - len(end) - len(t)) + end if i % 2 else t + end
        rows.append((i, t, "src"))
        (at_limit if i % 2 else away).add(i)
    rows += [(2000 + i, say(3) + "\n\n- one of those\n- another of those\n\nThat is all of it.", "src") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id for r in truncation.truncated_texts(df).where("is_cut").collect()}
    blind = {r.doc_id for r in truncation.truncated_texts(df, use_lengths=False).where("is_cut").collect()}
    assert at_limit <= found and not found & away
    assert abs(len(at_limit & blind) - len(away & blind)) <= 3  # without lengths they look the same


def test_censored_fit():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(5, 0.8, 20_000))
    lengths, counts = np.unique(np.minimum(x, 200).round(), return_counts=True)
    mu, sigma = truncation.censored_fit(lengths, counts, lengths == 200)
    assert abs(mu - 5) < 0.05 and abs(sigma - 0.8) < 0.05


# ------------------------------------------------------------------ queries


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p4_scores", "p5_found", "p5_frequencies", "p6_bounds", "p7_bounds"])
def test_query_against_sql(spark, duck, small, name):
    from conftest import comparable
    from textquarry.llm.oracles import oracle_sql

    df = queries()[name](spark, small)
    cursor = duck.execute(oracle_sql()[name])
    assert comparable(df.columns, [tuple(r) for r in df.collect()]) == comparable([c[0] for c in cursor.description], cursor.fetchall())
