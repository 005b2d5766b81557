"""Index against brute force, ranking behaviour, configuration."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from textquarry.functions.lexical import FIELDS, Analyzer
from textquarry.operators import index as ix, ranking
from textquarry.operators.fields import FIELD_GAP, IndexConfig, analyzed, field_view

PROJECT = "id long, site string, url string, nome string, dono string, descricao string, resumo string, topicos array<string>, categorias array<string>, linguagem string, estrelas int, forks int, licenca string, readme string, downloads_semana int, nota double, num_avaliacoes int, ultima_atualizacao string, coletado_em string"
SEVEN = [("python", "a tool", "x"), ("tool", "python library", "x"), ("tool", "a tool", "python"), ("tool", "a tool", "python " * 5), ("rust", "systems", "fast"), ("java", "jvm", "common common"), ("common", "common thing", "common")]


def projects(spark, rows):
    full = [(i, "github", f"u{i}", n, None, d, None, None, None, None, 0, None, "", r, None, None, None, None, "") for i, (n, d, r) in enumerate(rows)]
    return spark.createDataFrame(full, PROJECT)


def brute(config, docs):
    """term -> unit -> positions by field, and the units' documents."""
    found, owners = defaultdict(lambda: defaultdict(lambda: defaultdict(list))), []
    for doc in docs:
        t = [doc[f] for f in FIELDS]
        if config.granularity == "campo":
            segs = [[(f, x, 0) for f, x in enumerate(t)]]
        else:
            chained, base = [], 0
            for x in t if config.granularity == "documento" else t[:3]:
                chained.append((0, x, base))
                base += len(x) + FIELD_GAP
            segs = [chained]
            if config.granularity == "chunk":
                at, step = 0, config.chunk - config.overlap
                while t[3]:
                    segs.append([(0, t[3][at : at + config.chunk], at)])
                    if at + config.chunk >= len(t[3]):
                        break
                    at += step
        for unit in segs:
            for f, words, base in unit:
                for p, w in enumerate(words, base):
                    found[w][len(owners)][f].append(p)
            owners.append(doc["doc_id"])
    return found, owners


@pytest.mark.parametrize("options", [{"granularity": "campo"}, {"granularity": "documento"}, {"granularity": "chunk", "chunk": 50, "overlap": 10}])
def test_index_against_brute_force(spark, small, options):
    analyzer = Analyzer(stemming=False)
    config = IndexConfig(analyzer=analyzer, **options)
    table = spark.read.parquet(f"{small}/projetos.parquet")
    docs = sorted((r.asDict() for r in analyzed(field_view(table), analyzer).collect()), key=lambda d: d["doc_id"])
    want, owners = brute(config, docs)
    index = ix.build(table, config)
    assert [r.doc_id for r in index.units.orderBy("unit_id").collect()] == owners
    n = len(config.fields)
    got = {(r.term, r.unit_id): list(r.tf) for r in index.postings.collect()}
    assert got == {(w, u): [len(p.get(f, [])) for f in range(n)] for w, us in want.items() for u, p in us.items()}
    places = {(r.term, r.unit_id, r.field): list(r.pos) for r in index.positions.collect()}
    assert places == {(w, u, f): sorted(x) for w, us in want.items() for u, p in us.items() for f, x in p.items()}
    lexicon = {r.term: (r.df, r.cf) for r in index.lexicon.collect()}
    assert lexicon == {w: (len(us), sum(len(x) for p in us.values() for x in p.values())) for w, us in want.items()}


def test_a_built_index_is_planned_from_tables(spark):
    """The plans of an index's tables do not hold those that they are made from."""
    index = ix.build(projects(spark, SEVEN), IndexConfig())
    for table in (index.units, index.postings, index.positions, index.lexicon):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "InMemoryRelation" not in plan and "Generate" not in plan and len(plan) < 2000
    index.release()


def test_ranking_behaviour(spark):
    index = ix.build(projects(spark, SEVEN), IndexConfig())
    queries = spark.createDataFrame([(1, "python"), (2, "inexistentexyz"), (3, ""), (4, "common python")], "qid int, text string")
    top = ranking.search(index, queries, k=5).orderBy("qid", "rank").collect()
    one = [r.doc_id for r in top if r.qid == 1]
    assert set(one) == {0, 1, 2, 3} and one[0] == 0
    assert one.index(1) < one.index(2) and one.index(3) < one.index(2)
    assert not [r for r in top if r.qid in (2, 3)]
    assert len([r for r in top if r.qid == 4]) == 5
    scores = [r.score for r in top if r.qid == 1]
    assert scores == sorted(scores, reverse=True) and scores[-1] > 0
    idf = {r.df: r.idf for r in ranking.idf_table(index).collect()}
    assert idf[min(idf)] > idf[max(idf)]


def test_written_index_prunes_buckets(spark, tmp_path):
    config = IndexConfig(partitions=3)
    ix.write(ix.build(projects(spark, SEVEN), config), str(tmp_path / "i"))
    index = ix.open_index(spark, str(tmp_path / "i"), config)
    hit = ix.lookup(index.postings, "python", 3)
    assert {r.unit_id for r in hit.collect()} == {0, 1, 2, 3}
    assert "PartitionFilters: [isnotnull(bucket" in hit._jdf.queryExecution().executedPlan().toString()
    assert [r.unit_id for r in ranking.phrase_units(index, ["python", "librari"]).collect()] == [1]


def test_written_index_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "i")
    ix.write(ix.build(projects(spark, SEVEN), IndexConfig(partitions=3, granularity="documento")), path)
    ix.write(ix.build(projects(spark, SEVEN[:2]), IndexConfig(partitions=5, positions=False)), path)
    index = ix.open_index(spark, path)
    assert index.config == IndexConfig(partitions=5, positions=False) and index.positions is None
    assert index.units.count() == 2 and [p.name for p in tmp_path.iterdir()] == ["i"]


def test_kept_index(spark, tmp_path):
    """Built once, shared by configurations of one analysis, built again when the table changes."""
    table = str(tmp_path / "projetos.parquet")
    projects(spark, SEVEN).write.parquet(table)
    first = ix.kept_index(spark.read.parquet(table), IndexConfig())
    again = ix.kept_index(spark.read.parquet(table), IndexConfig())
    assert sorted(first.postings.inputFiles()) == sorted(again.postings.inputFiles())
    assert ix.kept_index(spark.read.parquet(table), IndexConfig(granularity="documento")).units.count() == 7
    projects(spark, SEVEN[:3]).write.mode("overwrite").parquet(table)
    assert ix.kept_index(spark.read.parquet(table), IndexConfig()).units.count() == 3


def test_gaps_and_sums_by_bands(spark):
    from textquarry.functions.plan import sums_before

    rows = [(t, u) for t, step in (("a", 1), ("b", 7), ("c", 101)) for u in range(step, 500, step)]
    df = spark.createDataFrame(rows, "term string, unit_id long")
    want = {(t, u): u - max([v for w, v in rows if w == t and v < u], default=0) for t, u in rows}
    for band in (1, 16, 1 << 16):
        assert {(r.term, r.unit_id): r.gap for r in ix.gaps(df, band).collect()} == want
    sums = sums_before(df.groupBy("term", "unit_id").agg(F.count("*").alias("n")), "unit_id", ("term",), width=10, before="n")
    assert {(r.term, r.unit_id): r.before for r in sums.collect()} == {(t, u): sum(1 for w, v in rows if w == t and v < u) for t, u in rows}


def test_sweep(spark, tmp_path):
    from textquarry.cli import SWEEP, sweep

    projects(spark, SEVEN).write.parquet(str(tmp_path / "p.parquet"))
    few = {n: SWEEP[n] for n in ("documento", "chunk_64", "sem_stemming")}
    rows = {r.configuracao: r for r in sweep(spark.read.parquet(str(tmp_path / "p.parquet")), few).collect()}
    assert rows.keys() == few.keys() and rows["documento"].unidades == 7 and rows["chunk_64"].unidades == 12  # two readmes of one letter have no term
    assert rows["documento"].ocorrencias == rows["sem_stemming"].ocorrencias


def test_marks_are_folded(spark):
    from textquarry.functions.lexical import fold

    words = {"Ação": "acao", "STRASSE": "strasse", "Straße": "strasse", "سَلَام": "سلام", "שָׁלוֹם": "שלום", "cafe\u0301": "cafe", "plain": "plain"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.f for r in df.select("w", fold(F.col("w")).alias("f")).collect()} == words


@pytest.mark.parametrize("bad", [{"granularity": "x"}, {"granularity": "chunk", "chunk": 10, "overlap": 10}, {"partitions": 0}, {"block": 0}])
def test_bad_options(bad):
    with pytest.raises(ValueError):
        IndexConfig(**bad).validate()


def test_empty_collection(spark):
    index = ix.build(projects(spark, []), IndexConfig())
    queries = spark.createDataFrame([(1, "python")], "qid int, text string")
    assert ranking.search(index, queries).count() == 0
    assert index.lexicon.count() == 0
