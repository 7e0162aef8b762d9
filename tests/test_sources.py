"""Configuration, downloads, formats, files and the command line."""

from __future__ import annotations

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

import docloom
from docloom import cli, log
from docloom import schema as S
from docloom.operators import markdown, openref
from docloom.plans import generate, universal
from docloom.sources import config, detect, fetch, files, sink

SPEC = """info: {id: demo, title: Demo, description: About it}
functions:
  - {id: select, title: Fetch rows, description: Reads., examples: [{id: a, name: Basic, code: "x = 1", isSpotlight: true}]}
  - {id: insert, title: Add rows, overwriteParams: [{name: p, isOptional: true, n: 1.0, list: []}]}
  - {id: other, title: Not listed}
"""


def version(name: str, local: str | None, url: str = "http://127.0.0.1:9/none.yml") -> dict:
    return {"displayName": f"Demo {name}", "spec": {"url": url} | ({"localPath": local} if local else {}), "output": {"baseDir": "o", "filenamePrefix": f"demo-{name}"}}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "spec.yml").write_text(SPEC)
    local = str(tmp_path / "spec.yml")
    sdks = {"demo": {"name": "Demo", "language": "swift", "versions": {"v1": version("v1", local), "v2": version("v2", local)}}, "gone": {"name": "Gone", "language": "c", "versions": {"v1": version("v1", None)}}}
    cats = {"rows": {"title": "Rows", "description": "Row access", "systemPrompt": "Docs for {sdk_name}.", "operations": ["insert", "select"], "order": 1}, "none": {"title": "None", "description": "d", "systemPrompt": "p", "operations": [], "order": 2}}
    (tmp_path / "sdks.json").write_text(json.dumps({"sdks": sdks}))
    (tmp_path / "categories.json").write_text(json.dumps({"categories": cats}))
    return tmp_path


def test_config(spark, folder):
    conf = config.Config(spark, str(folder))
    assert [tuple(r)[:2] for r in config.pairs(conf.sdks()).collect()] == [("demo", "v1"), ("demo", "v2"), ("gone", "v1")]
    assert conf.version("demo")["version"] == "v2" and conf.version("demo", "v1")["displayName"] == "Demo v1" and conf.version("demo", "v1")["spec"]["format"] == "openref-0.1"
    assert conf.has_sdk("demo") and not conf.has_sdk("x") and conf.has_category("rows") and not conf.has_category("x")
    assert conf.category("rows").first().operations == ["insert", "select"]
    assert [r.category for r in config.by_order(conf.categories()).collect()] == ["rows", "none"]
    for bad in (lambda: conf.sdk("x"), lambda: conf.category("x"), lambda: conf.version("demo", "v9"), lambda: conf.version("x")):
        with pytest.raises(config.ConfigError):
            bad()
    conf.clear()
    sdks = json.loads((folder / "sdks.json").read_text())
    sdks["sdks"]["demo"]["versions"]["v1"]["spec"]["url"] = "not a url"
    (folder / "sdks.json").write_text(json.dumps(sdks))
    with pytest.raises(config.ConfigError, match="demo"):
        config.Config(spark, str(folder))


@pytest.fixture
def server(tmp_path):
    (tmp_path / "web").mkdir()
    (tmp_path / "web/a.yml").write_text("info: é\n", encoding="utf-8")
    handler = lambda *a: type("H", (http.server.SimpleHTTPRequestHandler,), {"log_message": lambda *_: None})(*a, directory=str(tmp_path / "web"))
    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_download_and_cache(spark, server, tmp_path):
    cache = fetch.Cache(str(tmp_path / "cache"))
    row = {"sdk": "s", "version": "v1", "spec": {"localPath": None, "url": f"{server}/a.yml"}}
    assert not cache.has("s", "v1") and cache.get("s", "v1") is None
    path = fetch.resolve(row, cache)
    assert path == cache.get("s", "v1") == cache.path("s", "v1") and open(path, encoding="utf-8").read() == "info: é\n"
    (tmp_path / "web/a.yml").write_text("info: new\n")
    assert open(fetch.resolve(row, cache)).read() == "info: é\n" and open(fetch.resolve(row, cache, force=True)).read() == "info: new\n"
    (tmp_path / "own.yml").write_text("own")
    local = row | {"spec": {"localPath": str(tmp_path / "own.yml"), "url": f"{server}/a.yml"}}
    assert fetch.resolve(local, cache) == str(tmp_path / "own.yml") and fetch.resolve(local, cache, force=True) == path
    assert cache.clear("s", "v9") == 0 and cache.clear("s", "v1") == 1 and not cache.has("s", "v1")
    fetch.resolve(row, cache)
    assert cache.clear() == 1 and fetch.Cache(str(tmp_path / "absent")).clear() == 0
    for url in (f"{server}/none.yml", "http://127.0.0.1:9/x", "nonsense:"):
        with pytest.raises((fetch.FetchError, ValueError)):
            fetch.download(url)
    got = {r.url.rsplit("/", 1)[1]: (r.text, r.error is None) for r in fetch.downloads(spark.createDataFrame([(f"{server}/a.yml",), (f"{server}/none.yml",)], "url string")).collect()}
    assert got == {"a.yml": ("info: new\n", True), "none.yml": (None, False)}
    ways = spark.createDataFrame([(("l",), True, True), (("l",), False, True), ((None,), True, False), (("",), True, False)], "spec struct<localPath:string>, local_exists boolean, cache_exists boolean")
    assert [r.way for r in fetch.plan(ways).collect()] == ["local", "cache", "download", "download"] and {r.way for r in fetch.plan(ways, force=True).collect()} == {"download"}


def test_formats(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / "s.yaml").write_text(SPEC)
    (tmp_path / "plain.yml").write_text("a: 1")
    (tmp_path / "empty").mkdir()
    reg = detect.Registry()
    assert reg.names() == [S.OPENREF, S.MARKDOWN] and reg.get("x") is None
    assert reg.detect(str(tmp_path / "a.md")) == S.MARKDOWN and reg.detect(str(tmp_path / "s.yaml")) == S.OPENREF and reg.detect("anything", "x") == "x"
    for bad in ("plain.yml", "empty", "none.txt"):
        with pytest.raises(detect.ParserError, match="openref, markdown"):
            reg.detect(str(tmp_path / bad))
    reg.register(detect.Format("text", lambda p: p.endswith(".txt"), lambda s, p: s.range(1)))
    assert reg.detect("x.txt") == "text" and detect.registry().names() == [S.OPENREF, S.MARKDOWN] and detect.registry() is detect.registry()
    rows = spark.createDataFrame([("a.md", ""), ("b.yml", "info: x"), ("c.yml", "a: 1"), ("d.txt", "info:")], "path string, text string")
    assert {r.path: r.format for r in detect.detected(rows).collect()} == {"a.md": S.MARKDOWN, "b.yml": S.OPENREF, "c.yml": None, "d.txt": None}
    assert {r.format for r in detect.detected(rows, "x").collect()} == {"x"}
    assert detect.parse(spark, str(tmp_path / "s.yaml")).where("type = 'operation'").count() == 3
    paths = [str(tmp_path / x) for x in ("a.md", "s.yaml", "plain.yml", "empty", "none.md")] + [str(tmp_path)]
    got = {r.path.rsplit("/", 1)[1]: r.valid for r in detect.validate(spark, paths[:-1]).collect()}
    assert got == {"a.md": True, "s.yaml": True, "plain.yml": True, "empty": False, "none.md": False}
    report = detect.validate(spark, paths[-2:]).collect()
    assert [(r.valid, r.severity) for r in report] == [(False, "error"), (True, None)] and "not found" in report[0].message and report[0].file == paths[-2]


def test_markdown_folder(spark, tmp_path):
    """Files in the order of their path components, hidden ones too, under one root; each is a section, with no categories."""
    for name, text in {"b.md": "# B\n\n## Two\n", "a/z.md": "text only", "a-b/y.md": "# Y\n", ".hidden.md": "# H", "c.txt": "# no"}.items():
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(text)
    root = str(tmp_path / "docs")
    assert [p.removeprefix(root + "/") for p in files.markdown_files(root)] == [".hidden.md", "a/z.md", "a-b/y.md", "b.md"]
    nodes = detect.parse(spark, root)
    got = [(r.path, r.type, r.title) for r in nodes.orderBy("path").collect()]
    assert got == [([], "root", "docs"), ([1], "section", "H"), ([1, 1], "section", "H"), ([2], "section", "z"), ([3], "section", "Y"), ([3, 1], "section", "Y"), ([4], "section", "B"), ([4, 1], "section", "B"), ([4, 1, 1], "section", "Two")]
    assert nodes.where("type = 'root'").first().metadata == {"format": "markdown", "count": "4"}
    assert {r.path.rsplit("/", 1)[1] for r in files.tree_texts(spark, root).collect()} == {"z.md", "y.md", "b.md"}
    with pytest.raises(detect.ParserError):
        detect.parse_markdown(spark, str(tmp_path / "none"))
    assert files.head(f"{root}/b.md", 3) == "# B" and files.exists(root) and not files.exists(root + "x")


def test_modular_files(spark):
    """Each category under the top has a file; of equal names the last one stays, and one named full replaces the full file."""
    text = "## First\n\none\n\n### Inner\n\n## Full\n\nwhole\n\n## First\n\nlast\n"
    nodes = markdown.document_nodes(spark.createDataFrame([("t.md", text)], "path string, text string"))
    options = universal.Options(date="D", filename_prefix="p", title="T", system_prompt="S", include_metadata=False)
    got = {r.filename: r.content for r in universal.files(nodes, options).collect()}
    assert set(got) == {"p-first-llms.txt", "p-full-llms.txt"}
    assert got["p-first-llms.txt"] == "<SYSTEM>This is the developer documentation for T - First.</SYSTEM>\n\n# T First Documentation\n\n# . First\n\nlast\n\n"
    assert got["p-full-llms.txt"].startswith("<SYSTEM>This is the developer documentation for T - Full.")
    assert universal.full(nodes, options).first().content.startswith("<SYSTEM>S</SYSTEM>\n\n# T\n\n# . t\n\n## 1. First\n\none\n\n### 1.1. Inner\n\n## 2. Full")


def test_spec_as_json(spark):
    specs = openref.decode(spark.createDataFrame([("s", SPEC)], "path string, text string"))
    text = sink.spec_files(specs, F.lit("x.json")).first().content
    got = json.loads(text)
    assert got["operations"][1]["overwriteParams"] == [{"name": "p", "isOptional": True, "n": 1, "list": []}]
    assert '\n      "overwriteParams": [\n        {\n          "name": "p",\n          "isOptional": true,\n          "n": 1,\n          "list": []\n        }\n      ]' in text
    assert text.startswith('{\n  "info": {\n    "id": "demo",\n    "title": "Demo",') and '"examples": []' in text and text.endswith("\n}")


def test_written_names(spark, tmp_path):
    rows = spark.createDataFrame([("a/b.txt", "x\r\ny"), ("c.txt", "")], "filename string, content string")
    assert {r.filename: r.size for r in sink.write_files(rows, f"file://{tmp_path}/out").collect()} == {"a/b.txt": 4, "c.txt": 0}
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"x\r\ny" and not list(tmp_path.glob("out/**/*.part"))
    for name in ("../x.txt", "/tmp/docloom-x.txt", "a/../../x.txt"):
        with pytest.raises(Exception, match="not a name within"):
            sink.write_files(spark.createDataFrame([(name, "x")], "filename string, content string"), str(tmp_path / "out")).collect()


def test_command_line(spark, folder, capsys):
    run = lambda *a: cli.main(["--config", str(folder), *a], spark)
    assert run("list-sdks") == 0
    assert capsys.readouterr().out.splitlines() == ["demo\tDemo\tv1\tDemo v1", "demo\tDemo\tv2\tDemo v2", "gone\tGone\tv1\tDemo v1"]
    assert run("validate", "--sdk", "demo") == 0 and "demo v1: 3 operations, 1 examples" in capsys.readouterr().out
    assert run("validate", "--sdk", "nobody") == 1 and "unknown SDK" in capsys.readouterr().out
    assert run("generate") == 1
    out = folder / "out"
    assert run("generate", "--sdk", "all", "--output", str(out)) == 1
    said = capsys.readouterr().out
    assert "demo v1: 3 operations, 1 examples, 2 files" in said and "gone" in said
    assert {str(p.relative_to(out)) for p in out.rglob("*") if p.is_file()} == {"demo/v1/parsed/demo-v1.json", "demo/v1/llm-docs/demo-v2-rows-llms.txt", "demo/v1/llm-docs/demo-v2-full-llms.txt"}
    rows = (out / "demo/v1/llm-docs/demo-v2-rows-llms.txt").read_text()
    assert rows.startswith("<SYSTEM>Docs for Demo v2.</SYSTEM>\n\n# Demo v2 Rows Documentation\n\nRow access\n\n# 1. Add rows\n\n") and "# 2. Fetch rows" in rows and "Not listed" not in rows
    (folder / "doc.md").write_text("# Doc\n\nHello\n")
    assert run("--verbose", "generate", "--source", str(folder / "doc.md"), "--output", str(folder / "md"), "--prefix", "d") == 0
    assert "# . Doc" in (folder / "md/d-full-llms.txt").read_text()
    assert run("generate", "--source", str(folder / "none"), "--output", str(folder / "md")) == 1
    conf = config.Config(spark, str(folder))
    assert generate.tasks(conf, "all", "all") == [("demo", "v1"), ("demo", "v2"), ("gone", "v1")] and generate.tasks(conf, "demo", "v2") == [("demo", "v2")]


def test_log_levels(capsys):
    log.set_level(log.SILENT)
    log.plain("no")
    log.set_level(log.INFO)
    log.plain("yes")
    assert capsys.readouterr().out == "yes\n"


def test_surface():
    assert {name: callable(getattr(docloom, name)) for name in docloom.__all__ if name != "logger"} and docloom.Config is config.Config
    with pytest.raises(AttributeError):
        docloom.nothing  # noqa: B018
