"""Search service: a small Python API and an HTTP handler over an index."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import SparkSession, functions as F

from textquarry.operators import index as ix, ranking
from textquarry.operators.fields import IndexConfig

MAX_K, DEFAULT_K, POSTINGS_SHOWN = 50, 10, 15


class SearchService:
    """Answers single queries from a written index; results are at most k rows."""

    def __init__(self, spark: SparkSession, path: str, config: IndexConfig | None = None):
        self.spark = spark
        self.index = ix.open_index(spark, path, config)
        self.config = self.index.config.validate()

    def _terms(self, text: str):
        queries = self.spark.createDataFrame([(1, text)], "qid int, text string")
        return ranking.query_terms(queries, self.config.analyzer)

    def search(self, text: str, k: int = DEFAULT_K) -> dict:
        """Ranked documents and the lexicon entries of the query's terms."""
        rows = self._terms(text).orderBy("pos").collect()  # the terms of one query
        terms = self.spark.createDataFrame([(1, r.term, r.qtf, r.pos) for r in rows], "qid int, term string, qtf long, pos int")
        names = [r.term for r in rows]
        buckets = sorted({ix.bucket_number(t, self.config.partitions) for t in names})
        near = lambda df: df.where(F.col("bucket").isin(buckets) & F.col("term").isin(names)) if names else df.where("false")
        pruned = ix.Index(self.config, self.index.units, near(self.index.postings), None, near(self.index.lexicon), self.index.documents)
        top = ranking.top_k(ranking.document_scores(pruned, ranking.unit_scores(pruned, terms)), k, digits=3)
        found = ranking.hydrate(top, self.index.documents).orderBy("rank").collect()
        entries = {r.term: (r.df, r.cf) for r in pruned.lexicon.collect()}
        return {
            "consulta": text,
            "termos": [{"termo": t, "df": entries.get(t, (0, 0))[0], "cf": entries.get(t, (0, 0))[1]} for t in names],
            "resultados": [r.asDict() for r in found],
        }

    def term(self, text: str, limit: int = POSTINGS_SHOWN) -> dict:
        """df, cf, bucket and the first postings of a term; the raw text is
        looked up where the analysis leaves nothing."""
        row = self._terms(text).orderBy("pos").first()
        term = row.term if row else text
        p = self.config.partitions
        entry = ix.lookup(self.index.lexicon, term, p).first()
        hits = ix.lookup(self.index.postings, term, p).orderBy("unit_id").limit(limit)
        named = hits.join(self.index.units.select("unit_id", "doc_id"), "unit_id").join(self.index.documents.select("doc_id", "nome", "url"), "doc_id")
        return {
            "termo": term,
            "df": entry.df if entry else 0,
            "cf": entry.cf if entry else 0,
            "particao": ix.bucket_number(term, p),
            "postings": [r.asDict() for r in named.select("unit_id", "doc_id", "nome", "url", "tf").orderBy("unit_id").collect()],
        }

    def info(self) -> dict:
        return ix.collection_statistics(self.index).first().asDict()


def clamp_k(text: str | None) -> int:
    """The number of results asked for, 1 to 50, 10 where it is no number."""
    try:
        return max(1, min(MAX_K, int(text)))
    except (TypeError, ValueError):
        return DEFAULT_K


def answer(service: SearchService, path: str) -> tuple[int, dict]:
    """Status and body of a request path."""
    parts = urlsplit(path)
    args = {k: v[0] for k, v in parse_qs(parts.query).items()}
    if parts.path == "/api/info":
        return 200, service.info()
    if parts.path in ("/api/buscar", "/api/termo"):
        text = args.get("q" if parts.path.endswith("buscar") else "t", "").strip()
        if not text:
            return 400, {"erro": "consulta vazia"}
        return 200, service.search(text, clamp_k(args.get("k"))) if parts.path.endswith("buscar") else service.term(text)
    return 404, {"erro": "caminho desconhecido"}


def serve(service: SearchService, port: int = 8000) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            status, body = answer(service, self.path)
            data = json.dumps(body, ensure_ascii=False, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
