"""Request handlers without a web framework: dictionaries in, (status, body) out; serve() puts them behind HTTP."""

from __future__ import annotations

import html
import json
import time
from typing import Any
from urllib.parse import parse_qs, urlparse

from pyspark.sql import SparkSession

from rankforge.config import Config, ConfigError
from rankforge.operators.chunking import corpus_statistics
from rankforge.plans.experiments import Runner, best_of
from rankforge.plans.report import Analysis
from rankforge.plans.retrieval import DocumentPipeline, Retriever
from rankforge.sources import storage, stores


EMBEDDINGS = "data/embeddings"
ALIASES = {"search": "retrieve", "openapi.json": "openapi", "redoc": "docs"}  # a POST to /search is one to /retrieve; the configuration search is a method of the service alone
ANSWERS = {200: "done", 400: "a bad value", 404: "no such file, experiment or route", 422: "a missing field", 500: "an error"}
RUN = ("corpus_path!", "dataset_path", "experiment_directory", "notes", "serving")
FIELDS = {  # what a route reads besides the configuration; "!" marks what it needs
    "ingest": ("source!", "output_path"), "preprocess": ("source!", "output_path"), "chunk": ("source!", "output_path"), "embed": ("corpus_path!", "output_path"), "index": ("corpus_path!", "index_path"),
    "retrieve": ("query!", "index_path", "top_k"), "search": ("query!", "index_path", "top_k"), "evaluate": RUN, "benchmark": (*RUN, "mode", "parameters", "parameters_path"), "compare": ("experiment_ids!", "experiment_directory"),
    "experiments": ("experiment_directory",), "experiment": ("id!", "experiment_directory"), "history": ("experiment_directory",), "leaderboard": ("sort_by", "experiment_directory"),
    "recommendation": ("experiment_directory",), "reports": ("experiment_directory",), "visualizations": ("experiment_directory",),
}


class Service:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._loaded: dict[tuple[str, str], Retriever] = {}

    def config(self, body: dict) -> Config:
        return Config.load(body["config_path"], lambda p: storage.read_text(self.spark, p)) if body.get("config_path") else Config(body.get("config"))

    def analysis(self, body: dict) -> Analysis:
        c = self.config(body)
        return Analysis(self.spark, body.get("experiment_directory") or c["benchmark.experiment_directory"], c)

    def health(self, body: dict) -> dict:
        return {"status": "ok", "spark": self.spark.version}

    def ingest(self, body: dict) -> dict:
        docs = DocumentPipeline(self.spark, self.config(body)).ingest(body["source"])
        if body.get("output_path"):
            stores.export_json(docs, body["output_path"])
        return {"document_count": docs.count()}

    def preprocess(self, body: dict) -> dict:
        p = DocumentPipeline(self.spark, self.config(body))
        docs = p.preprocess(p.ingest(body["source"]))
        if body.get("output_path"):
            stores.export_json(docs, body["output_path"])
        return {"document_count": docs.count()}

    def chunk(self, body: dict) -> dict:
        return corpus_statistics(*DocumentPipeline(self.spark, self.config(body)).process(body["source"], body.get("output_path"))).first().asDict()

    def _by_domain(self, config: Config, corpus: str, base: str) -> str:
        """A default path, with the domain of a corpus that lies in a folder of its own below the output directory."""
        folder, _, name = storage.resolved(self.spark, corpus).rstrip("/").rpartition("/")
        root = storage.resolved(self.spark, config["output.output_directory"]).rstrip("/")
        parent, _, domain = folder.rpartition("/")
        return f"{base}/{domain}" if name == config["output.processed_corpus_filename"] and parent == root else base

    def embed(self, body: dict) -> dict:
        c = self.config(body)
        at = body.get("output_path") or self._by_domain(c, body["corpus_path"], EMBEDDINGS)
        chunks = stores.load_corpus(self.spark, body["corpus_path"])[1]
        vectors = Retriever(self.spark, c).embed(chunks.select("chunk_id", "text"), "chunk_id")
        stores.save_vectors(vectors, at, c["embedding.model_name"])
        return {"vector_count": stores.load_vectors(self.spark, at).count(), "output_path": at}

    def index(self, body: dict) -> dict:
        c = self.config(body)
        at = body.get("index_path") or self._by_domain(c, body["corpus_path"], c["index.index_directory"])
        r = Retriever(self.spark, c).build(stores.load_corpus(self.spark, body["corpus_path"])[1])
        r.save(at)
        return {"chunk_count": r.chunks.count(), "configuration": r.configuration(), "index_path": at}

    def retrieve(self, body: dict) -> dict:
        """The cache knows configuration and index path both."""
        c = self.config(body)
        at = body.get("index_path") or c["index.index_directory"]
        key = (json.dumps(c.values, sort_keys=True), at)
        if key not in self._loaded:
            self._loaded[key] = Retriever(self.spark, c).load(at)
        return self._loaded[key].answer(body["query"], body.get("top_k"))

    def _runner(self, body: dict) -> tuple[Runner, Config]:
        c = self.config(body)
        return Runner(self.spark, body.get("experiment_directory") or c["benchmark.experiment_directory"], body.get("serving", "serve")), c

    def evaluate(self, body: dict) -> dict:
        runner, c = self._runner(body)
        return runner.run(c, body["corpus_path"], body.get("dataset_path") or c["benchmark.dataset_path"], notes=body.get("notes"))

    def benchmark(self, body: dict) -> dict:
        runner, c = self._runner(body)
        mode, at = body.get("mode", "single"), (body["corpus_path"], body.get("dataset_path") or c["benchmark.dataset_path"])
        given = body.get("parameters") or (stores.load_parameters(self.spark, body["parameters_path"]) if body.get("parameters_path") else {})
        runs = {"single": lambda: [runner.run(c, *at, notes=body.get("notes"))], "sweep": lambda: runner.sweep(c, *at, given, body.get("notes")), "grid_search": lambda: runner.grid(c, *at, given, body.get("notes"))}
        if mode not in runs:
            raise ValueError(f"mode must be one of {', '.join(runs)}")
        results = runs[mode]()
        best = best_of(results)
        return {"experiments": results, "best": best["experiment_id"] if best else None, "value": best["ndcg_at_k"] if best else None}

    def search(self, body: dict) -> dict:
        runner, c = self._runner(body)
        space = body.get("space") or stores.load_parameters(self.spark, body["search_space_path"])
        results, best, value = runner.search(c, body["corpus_path"], body.get("dataset_path") or c["benchmark.dataset_path"], space, body.get("trials", 20), body.get("objective", "ndcg"), body.get("notes"), body.get("seed"))
        return {"trials": len(results), "best": best, "value": value}

    def experiments(self, body: dict) -> dict:
        return {"experiments": [r.asDict() for r in self.analysis(body).history().collect()]}

    def history(self, body: dict) -> dict:
        """The experiments, newest first, with what the analysis adds to each."""
        return {"experiments": [r.asDict() for r in self.analysis(body).enriched().collect()]}

    def experiment(self, body: dict) -> dict:
        return self.analysis(body).store.get(body["id"])

    def compare(self, body: dict) -> dict:
        return {"rows": [r.asDict() for r in self.analysis(body).compare(body["experiment_ids"]).collect()]}

    def leaderboard(self, body: dict) -> dict:
        return {"rows": [r.asDict() for r in self.analysis(body).leaderboard(body.get("sort_by", "overall_score")).collect()]}

    def recommendation(self, body: dict) -> dict:
        return self.analysis(body).recommendation()

    def reports(self, body: dict) -> dict:
        return {"reports": self.analysis(body).reports(body.get("experiment_ids"))}

    def visualizations(self, body: dict) -> dict:
        return self.analysis(body).charts()

    def openapi(self, body: dict) -> dict:
        """The routes with the fields that they read."""
        paths: dict[str, dict] = {}
        for method, name in sorted(self.ROUTES):
            operation: dict = {"summary": (getattr(self, ALIASES.get(name, name)).__doc__ or name.replace("_", " ")).strip().split("\n")[0], "responses": {str(code): {"description": text} for code, text in ANSWERS.items()}}
            fields = FIELDS.get(name, ())
            kind = lambda f: {"type": "integer" if f in ("top_k", "trials", "seed") else "array" if f == "experiment_ids" else "object" if f in ("config", "parameters") else "string"} | ({"items": {"type": "string"}} if f == "experiment_ids" else {})
            if method == "POST":
                schema = {"type": "object", "properties": {f.rstrip("!"): kind(f.rstrip("!")) for f in ("config_path", "config", *fields)}, "required": [f.rstrip("!") for f in fields if f.endswith("!")]}
                operation["requestBody"] = {"content": {"application/json": {"schema": schema}}}
            else:
                operation["parameters"] = [{"name": f.rstrip("!"), "in": "path" if f == "id!" else "query", "required": f.endswith("!"), "schema": kind(f.rstrip("!"))} for f in fields]
            paths.setdefault("/experiment/{id}" if name == "experiment" else "/openapi.json" if name == "openapi.json" else f"/{name}", {})[method.lower()] = operation
        return {"openapi": "3.1.0", "info": {"title": "rankforge", "version": "1"}, "paths": paths}

    def docs(self, body: dict) -> str:
        """The routes as a page."""
        rows = "".join(f"<tr><td>{m.upper()}</td><td>{html.escape(path)}</td><td>{html.escape(o['summary'])}</td></tr>" for path, held in self.openapi(body)["paths"].items() for m, o in held.items())
        return f"<!doctype html><meta charset=utf-8><title>rankforge</title><table>{rows}</table>"

    ROUTES = {
        ("GET", "openapi.json"), ("GET", "docs"), ("GET", "redoc"),
        ("GET", "health"), ("POST", "ingest"), ("POST", "preprocess"), ("POST", "chunk"), ("POST", "embed"), ("POST", "index"), ("POST", "retrieve"), ("POST", "search"), ("POST", "evaluate"), ("POST", "benchmark"),
        ("POST", "compare"), ("GET", "experiments"), ("GET", "experiment"), ("GET", "leaderboard"), ("GET", "recommendation"), ("GET", "reports"), ("GET", "visualizations"), ("GET", "history"),
    }

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict[str, Any]]:
        """Status and body. Missing fields are 422, bad values 400, missing files and experiments 404, all else 500."""
        url = urlparse(path)
        name, _, rest = url.path.strip("/").partition("/")
        given = {k: v[0] for k, v in parse_qs(url.query).items()} | (body or {}) | ({"id": rest} if rest else {})
        if (method, name) not in self.ROUTES:
            return 404, {"detail": f"no {method} {url.path}", "suggestion": "see /health"}
        try:
            return 200, getattr(self, ALIASES.get(name, name))(given)
        except KeyError as e:
            missing = str(e.args[0])
            return (404, {"detail": missing, "suggestion": "list the experiments"}) if missing.startswith("no experiment") else (422, {"detail": f"missing field {missing}", "suggestion": "add it"})
        except FileNotFoundError as e:
            return 404, {"detail": str(e), "suggestion": "check the path or id"}
        except (ConfigError, ValueError) as e:
            return 400, {"detail": str(e), "suggestion": "correct the request"}
        except Exception as e:
            return 500, {"detail": f"{type(e).__name__}: {e}", "suggestion": "see the log"}


def serve(spark: SparkSession, port: int = 8000) -> None:
    """A plain HTTP server over handle(), with the time of each request in X-Execution-Time-Ms."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    service = Service(spark)

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            start = time.perf_counter()
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, body = service.handle(self.command, self.path, json.loads(raw) if raw else {})
            except json.JSONDecodeError as e:
                status, body = 422, {"detail": str(e), "suggestion": "send JSON"}
            page = isinstance(body, str)
            out = body.encode() if page else json.dumps(body, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
            self.send_header("X-Execution-Time-Ms", f"{(time.perf_counter() - start) * 1000:.2f}")
            self.send_header("Content-Length", str(len(out)))
            self.end_headers()
            self.wfile.write(out)

        do_GET = do_POST = answer

    ThreadingHTTPServer(("127.0.0.1", port), Handler).serve_forever()
