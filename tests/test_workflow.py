"""Files to reports: sources, experiment runs, analysis, service, command line and streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rankforge import cli
from rankforge.config import Config
from rankforge.operators import analysis
from rankforge.plans.experiments import Runner, check_space
from rankforge.plans.tpe import propose, suggest
from rankforge.plans.report import Analysis
from rankforge.plans.retrieval import DocumentPipeline
from rankforge.service import Service
from rankforge.sources import files, stores
from rankforge.streaming import ingest as streaming

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
TEXTS = ["Maternity leave policy offers sixteen weeks of paid leave.", "Remote work policy allows hybrid schedules.", "Travel reimbursement covers flights and hotels."]


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "raw"
    (root / "nested").mkdir(parents=True)
    (root / "sample.txt").write_text("Plain text sample.\nSecond line of the sample.")
    (root / "nested" / "sample.md").write_text("# Heading\n\nMarkdown body.")
    (root / "ignore.bin").write_bytes(b"\x00\x01")
    with zipfile.ZipFile(root / "sample.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>DOCX ingestion validates extraction.</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (root / "broken.docx").write_bytes(b"not a zip")
    return root


def test_ingest(spark, folder):
    found = files.ingest(spark, str(folder))
    got = {r.filename: r for r in found.documents.collect()}
    assert set(got) == {"sample.txt", "sample.md", "sample.docx"}
    assert got["sample.docx"].text == "DOCX ingestion validates extraction." and got["sample.docx"].paragraph_count == 1 and got["sample.txt"].file_type == "txt"
    assert got["sample.md"].title == "sample" and got["sample.txt"].size_bytes == (folder / "sample.txt").stat().st_size
    assert [r.source.split("/")[-1] for r in found.failures.collect()] == ["broken.docx"]
    assert files.ingest_path(spark, str(folder / "sample.txt")).count() == 1
    for bad, error in (("ignore.bin", ValueError), ("broken.docx", ValueError), ("none.txt", FileNotFoundError)):
        with pytest.raises(error):
            files.ingest_path(spark, str(folder / bad))


def test_domains(spark, folder):
    with_root = files.ingest(spark, str(folder), root=str(folder)).documents.collect()
    assert [(r.filename, r.domain) for r in with_root] == [("sample.md", "nested")]  # files directly in a root with sub-directories are skipped
    assert files.domains(spark, str(folder)) == ["nested"]


@pytest.fixture()
def corpus(spark, tmp_path):
    rows = [(f"doc-handbook:{i}", "doc-handbook", t, i, 7, "employee_handbook", "memory") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([("doc-handbook", " ".join(TEXTS), "employee_handbook", "memory")], "document_id string, text string, title string, source string")
    stores.save_corpus(str(tmp_path / "corpus"), docs, spark.createDataFrame(rows, stores.CHUNK), {})
    dataset = {"name": "fixture", "examples": [{"query": "What is the maternity leave policy?", "positive_documents": ["doc-handbook:0"]}, {"query": "Which policy mentions hybrid schedules?", "positive_documents": ["doc-handbook:1"], "negative_documents": ["doc-handbook:2"]}]}
    (tmp_path / "dataset.json").write_text(json.dumps(dataset))
    return tmp_path


def config(base, **retrieval):
    return Config({"embedding": {"backend": "hashing"}, "retrieval": {"retriever": "bm25", "top_k": 2} | retrieval, "benchmark": {"results_directory": str(base / "results")}, "reporting": {"reports_directory": str(base / "reports")}, "visualization": {"output_directory": str(base / "charts")}})


def test_runs_and_analysis(spark, corpus):
    at, data = str(corpus / "corpus"), str(corpus / "dataset.json")
    runner = Runner(spark, str(corpus / "experiments"), mode="batch")
    c = config(corpus)
    first = runner.run(c, at, data)
    assert first["status"] == "completed" and first["mean_reciprocal_rank"] == 1.0 and first["recall_at_k"] == 1.0 and first["precision_at_k"] == 0.5 and "average_latency_ms" not in first
    serving = Runner(spark, str(corpus / "experiments"))
    swept = serving.sweep(c, at, data, {"retrieval.top_k": [1, 2]})
    grid = serving.grid(c, at, data, {"retrieval.top_k": [1], "retrieval.retriever": ["bm25"]})
    assert len(swept) == 2 and len(grid) == 1 and swept[0]["notes"] == "sweep:retrieval.top_k=1" and grid[0]["notes"] == "grid:retrieval.top_k=1, retrieval.retriever=bm25"
    assert swept[0]["p95_latency_ms"] > 0 and (corpus / "results" / f"{swept[0]['experiment_id']}_benchmark.json").exists()
    chunked = runner.ablation(c, at, data, {"top1": {"retrieval.top_k": 1}})
    assert [r["notes"] for r in chunked] == ["ablation:baseline", "ablation:top1"]
    results, best, value = runner.search(c, at, data, {"index.bm25.k1": {"type": "float", "low": 0.8, "high": 2.0}}, 2, seed=1)
    assert len(results) == 2 and best is results[-1] and value == best["ndcg_at_k"]

    view = Analysis(spark, str(corpus / "experiments"), c)
    assert view.history().count() == 8
    history = view.enriched().collect()
    assert len(history) == 8 and [r["rank"] for r in history if r.recommended] == [1] and all(r.overall_score for r in history if r["rank"])
    board = view.leaderboard("mrr").collect()
    assert [r["rank"] for r in board] == [1, 2, 3]  # batch runs have no latency and are not ranked
    assert view.recommendation()["experiment_id"] in {r.experiment_id for r in board}
    ids = [swept[1]["experiment_id"], swept[0]["experiment_id"]]
    assert [r.experiment_id for r in view.compare(ids).collect()] == ids
    with pytest.raises(KeyError):
        view.compare(["exp-none"])
    with pytest.raises(ValueError):
        view.leaderboard("speed")
    made = view.reports()
    assert len(made) == 3 and "## Recommendation" in open(made[0]["markdown_path"]).read() and json.load(open(made[0]["json_path"]))["experiment"]["summary"]
    assert "<table>" in open(view.charts()["leaderboard_html"]).read()

    (corpus / "bad.json").write_text(json.dumps([{"query": "x", "positive_documents": ["unknown_doc:99"]}]))
    with pytest.raises(ValueError):
        runner.run(c, at, str(corpus / "bad.json"))
    assert view.history().where("status = 'failed'").count() == 1


def test_scores(spark):
    schema = "experiment_id string, timestamp timestamp, retriever string, embedding_model string, query_enhancement string, reranker string, chunking_strategy string, precision_at_k double, recall_at_k double, mean_reciprocal_rank double, ndcg_at_k double, average_latency_ms double, p95_latency_ms double, p99_latency_ms double, embedding_time_ms double, index_build_time_ms double"
    from datetime import datetime

    def row(i, retriever, quality, cost):
        return (f"e{i}", datetime(2024, 1, i + 1), retriever, "m", "none", "none", "fixed", *[quality] * 4, *[cost] * 5)

    one = analysis.scored(spark.createDataFrame([row(0, "bm25", 0.8, 5.0)], schema)).first()
    assert abs(one.overall_score - (0.65 * 0.8 + 0.35)) < 1e-12
    df = spark.createDataFrame([row(0, "bm25", 0.8, 5.0), row(1, "dense", 0.9, 15.0), row(2, "dense", 0.5, 10.0), (*row(3, "bm25", None, None),)], schema)
    got = {r.experiment_id: r.overall_score for r in analysis.scored(df).collect()}
    assert got.keys() == {"e0", "e1", "e2"} and abs(got["e2"] - (0.65 * 0.5 + 0.35 * 0.5)) < 1e-12
    best = analysis.recommendation(analysis.scored(df)).first()
    assert best.experiment_id == "e0" and best.alternative_configurations == ["e1", "e2"] and best.recommended_pipeline == "fixed chunking + m + bm25 + none + none"
    t = analysis.tradeoffs(df).collect()
    assert [(r.component, r.best_quality, r.best_latency) for r in t] == [("Retriever", "bm25", "bm25")]
    assert len(analysis.observations(df)) == 1


def test_search_space():
    import random

    for space in ({"retrieval.retriever": ["bm25"]}, {"query_enhancement.enabled": [True]}, {}):
        with pytest.raises(ValueError):
            check_space(space, 2, "ndcg")
    rng = random.Random(0)
    assert suggest(rng, "a", {"type": "int", "low": 20, "high": 120, "step": 10}) % 10 == 0
    assert 0.1 <= suggest(rng, "a", {"type": "float", "low": 0.1, "high": 10, "log": True}) <= 10
    for bad in ([], "x", {"type": "int", "low": 0.5, "high": 2}, {"type": "odd"}):
        with pytest.raises(ValueError):
            suggest(rng, "a", bad)


def test_a_search_learns():
    """Trials gather where the values are large."""
    import random

    space = {"x": {"type": "float", "low": 0.0, "high": 10.0}, "n": {"type": "int", "low": 10, "high": 100, "step": 10}, "c": ["a", "b", "c"]}
    seen = []
    for i in range(60):
        t = propose(random.Random(i), space, seen)
        assert 0 <= t["x"] <= 10 and t["n"] % 10 == 0 and 10 <= t["n"] <= 100 and t["c"] in space["c"]
        seen.append((t, -((t["x"] - 7) ** 2) - ((t["n"] - 40) / 10) ** 2 - 20 * (t["c"] != "b")))
    late, early = [t for t, _ in seen[40:]], [t for t, _ in seen[:10]]
    assert sum(abs(t["x"] - 7) for t in late) / 20 < 0.6 * sum(abs(t["x"] - 7) for t in early) / 10
    assert sum(t["c"] == "b" for t in late) > 10 and max(v for _, v in seen) > -2


def test_components_by_name(spark, tmp_path, monkeypatch):
    """What is registered can be named in a configuration, and what is not is refused."""
    from rankforge.config import ConfigError
    from rankforge.operators import chunking, dense, ranking
    from rankforge.plans import retrieval

    for section in ({"chunking": {"strategy": "lines"}}, {"retrieval": {"fusion": {"strategy": "first"}}}, {"query_enhancement": {"enabled": True, "method": "twice"}}, {"reranking": {"backend": "length"}}, {"embedding": {"backend": "ones"}}):
        with pytest.raises(ConfigError):
            Config(section)
    monkeypatch.setitem(chunking.CHUNKERS, "lines", lambda c: F.split("text", "\n"))
    monkeypatch.setitem(ranking.FUSIONS, "first", lambda lists, k, c: lists[0].where(F.col("rank") <= k))
    monkeypatch.setitem(ranking.RERANKERS, "length", lambda c: lambda q, t: F.length(t).cast("double"))
    monkeypatch.setitem(dense.BACKENDS, "ones", dense.Backend(lambda t, k, s: t.select(k, F.array(F.lit(1.0), F.lit(1.0)).alias("vector")), lambda s: "ones"))

    class Twice(retrieval.Expansion):
        def fit(self, chunks):
            pass

        def enhance(self, queries, embed):
            return queries.withColumns({"enhanced_query": F.concat_ws(" ", "query", "query"), "expansion_terms": F.array().cast("array<string>")})

    monkeypatch.setitem(retrieval.ENHANCERS, "twice", Twice)
    files.register_loader(".rst", files.Loader("rst"))
    (tmp_path / "a.rst").write_text("one\ntwo words")
    (tmp_path / "b.log").write_text("not read")
    docs = files.ingest_path(spark, str(tmp_path))
    del files.LOADERS[".rst"]
    c = Config({
        "chunking": {"strategy": "lines"}, "embedding": {"backend": "ones"}, "retrieval": {"retriever": "hybrid", "top_k": 2, "fusion": {"strategy": "first"}},
        "query_enhancement": {"enabled": True, "method": "twice"}, "reranking": {"enabled": True, "backend": "length", "top_n": 1},
    })
    chunks = chunking.chunk_documents(docs, c)
    assert [r.text for r in chunks.orderBy("position").collect()] == ["one", "two words"]
    got = retrieval.Retriever(spark, c).build(chunks).answer("one")
    assert got["enhanced_query"] == "one one" and [r["text"] for r in got["results"]] == ["two words"] and got["reranking_latency_ms"] > 0 and got["total_latency_ms"] >= got["retrieval_latency_ms"]


def test_vectors_are_encoded_once(spark, tmp_path, monkeypatch):
    from rankforge.operators import dense

    asked = []
    encode = dense.BACKENDS["hashing"].encode
    counting = dense.Backend(lambda t, k, s: asked.append(t.count()) or encode(t, k, s), lambda s: "counted", lambda s: 384)
    monkeypatch.setitem(dense.BACKENDS, "counted", counting)
    settings = Config({"embedding": {"backend": "counted", "cache_directory": str(tmp_path / "v")}})["embedding"]
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None)], "id int, text string")
    first = {r.id: r.vector for r in dense.embed(texts, "id", settings).collect()}
    more = texts.union(spark.createDataFrame([(5, "d e")], "id int, text string"))
    second = {r.id: r.vector for r in dense.embed(more, "id", settings).collect()}
    assert asked == [3, 1] and all(second[i] == v for i, v in first.items()) and first[1] == first[2] and len(second) == 5
    plain = {r.id: r.vector for r in dense.embed(more, "id", settings | {"cache_directory": None}).collect()}
    assert plain == second


def test_preprocessed_documents_are_chunked_anew(spark, corpus):
    assert stores.load_preprocessed(spark, str(corpus / "corpus")).first().document_id == "doc-handbook"
    (corpus / "preprocessed_documents.json").write_text(json.dumps([{"id": "clean", "text": "cleaned words"}]))
    assert [r.document_id for r in stores.load_preprocessed(spark, str(corpus / "corpus")).collect()] == ["clean"]


def test_datasets(spark, tmp_path):
    assert len(stores.parse_examples({"query": "q", "positive_documents": ["d"]})) == 1
    for bad in ({}, "text", [{"query": " ", "positive_documents": ["d"]}], [{"query": "q", "positive_documents": []}]):
        with pytest.raises(ValueError):
            stores.parse_examples(bad)
    (tmp_path / "corpus.json").write_text(json.dumps({"documents": [{"id": "d", "text": "t"}], "chunks": [{"chunk_id": "d:0", "document_id": "d", "text": "t", "position": 0, "token_count": 1, "metadata": {"title": "T", "source": "S"}}]}))
    docs, chunks = stores.load_corpus(spark, str(tmp_path / "corpus.json"))
    assert docs.first().document_id == "d" and chunks.first().title == "T"


def test_service_and_cli(spark, folder, corpus, capsys):
    service = Service(spark)
    assert service.handle("GET", "/health")[0] == 200
    api = service.handle("GET", "/openapi.json")[1]
    assert set(api["paths"]) >= {"/retrieve", "/experiment/{id}", "/health"} and api["paths"]["/retrieve"]["post"]["requestBody"]["content"]["application/json"]["schema"]["required"] == ["query"]
    assert all("<table>" in service.handle("GET", p)[1] for p in ("/docs", "/redoc"))
    below = Config({"output": {"output_directory": str(corpus)}})
    assert service._by_domain(below, f"{corpus}/legal/processed_corpus.json", "base") == "base/legal" and service._by_domain(below, f"{corpus}/processed_corpus.json", "base") == "base"
    body = {"config": {"ingestion": {"input_directory": str(folder.parent)}, "retrieval": {"retriever": "bm25"}}}
    assert service.handle("POST", "/ingest", body | {"source": str(folder)})[1]["document_count"] == 3
    index = {"config": {"retrieval": {"retriever": "bm25", "top_k": 1}}, "index_path": str(corpus / "index")}
    assert service.handle("POST", "/index", index | {"corpus_path": str(corpus / "corpus")})[1]["chunk_count"] == 3
    status, found = service.handle("POST", "/search", index | {"query": "What is the maternity leave policy?"})
    assert status == 200 and found["results"][0]["chunk_id"] == "doc-handbook:0" and found["total_latency_ms"] >= found["retrieval_latency_ms"] > 0
    assert service.handle("POST", "/ingest", {})[0] == 422 and service.handle("POST", "/benchmark", {"corpus_path": "x", "mode": "odd"})[0] == 400
    assert service.handle("GET", "/none")[0] == 404 and service.handle("GET", f"/experiment/exp-none?experiment_directory={corpus}/experiments")[0] == 404
    assert cli.main(["retrieve", "--query", "hybrid schedules", "--index-path", str(corpus / "index"), "--top-k", "1", "--config", str(_yaml(corpus))], spark) == 0
    assert "doc-handbook:1" in capsys.readouterr().out
    assert cli.main(["ingest", str(folder / "absent")], spark) == 1


def _yaml(base):
    path = base / "c.yaml"
    path.write_text("retrieval:\n  retriever: bm25\n")
    return path


def test_document_pipeline(spark, folder, tmp_path):
    c = Config({"ingestion": {"input_directory": str(tmp_path)}, "chunking": {"chunk_size": 20, "overlap": 2}})
    docs, chunks = DocumentPipeline(spark, c).process(str(folder), str(tmp_path / "out"))
    assert docs.count() == 3 and {r.title for r in chunks.select("title").collect()} <= {"sample"}


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("one two three four five six seven eight nine")
    c = Config({"chunking": {"strategy": "fixed", "chunk_size": 5, "overlap": 2}})
    for extra in (None, "b.md"):
        if extra:
            (source / extra).write_text("ten eleven twelve")
        streaming.start(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), c, available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 4 and got.agg(F.count_distinct("document_id")).first()[0] == 2


def test_runs_share_an_index(spark, corpus, monkeypatch):
    """Settings of the search alone build no index anew; settings of the index do, and the last is given up at the end."""
    from rankforge.plans.retrieval import Retriever

    built, of = [], Retriever.build
    monkeypatch.setattr(Retriever, "build", lambda self, *args: built.append(self.kind) or of(self, *args))
    at, data, runner = str(corpus / "corpus"), str(corpus / "dataset.json"), Runner(spark, str(corpus / "experiments"), mode="batch")
    with runner:
        runs = runner.sweep(config(corpus), at, data, {"index.bm25.k1": [0.9, 2.0], "retrieval.top_k": [1, 2]})
        runs += runner.ablation(config(corpus), at, data, {"dense": {"retrieval.retriever": "dense"}, "top1": {"retrieval.top_k": 1}})
    assert built == ["bm25", "dense", "bm25"] and [r["top_k"] for r in runs] == [2, 2, 1, 2, 2, 2, 1]
    assert len({r["index_build_time_ms"] for r in runs}) == 3 and runner._built is None
    alone = runner.run(config(corpus).with_overrides({"index.bm25.k1": 2.0}), at, data)
    same = ("precision_at_k", "recall_at_k", "mean_reciprocal_rank", "ndcg_at_k")
    assert [alone[m] for m in same] == [runs[1][m] for m in same] and [r["retrieved"] for r in alone["query_results"]] == [r["retrieved"] for r in runs[1]["query_results"]]
