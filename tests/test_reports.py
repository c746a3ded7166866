import csv
import io
import json

import pytest

import duckdb
from sparkwarden import api, cli
from sparkwarden.operators import reports
from sparkwarden.plans import catalog
from sparkwarden.sources.config import ScanConfig
from sparkwarden.streaming import findings as streaming

from .test_engine import SECRET, table
from .test_sources import tree

FILES = {"app.py": f'pickle.loads(x)\nauth_token = "{SECRET}"\n', "b.py": "hashlib.md5(x)\n", "Dockerfile": "FROM node:latest\n"}


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    return api.scan(spark, tree(tmp_path_factory.mktemp("r"), FILES))


def test_order_cap_and_decision(spark, result):
    rows = result.findings.collect()
    assert [r.severity for r in rows] == ["critical", "high", "high", "medium", "low"] and result.failed() and result.worst_severity() == "critical"
    assert list(result.tally().values()) == [1, 2, 1, 1, 0]
    capped = api.scan(spark, result.config.root, max_findings=2)
    assert [r.key for r in capped.findings.collect()] == [r.key for r in rows[:2]] and capped.stats()["truncated"]
    low = api.scan(spark, result.config.root, min_severity="critical", select=["python.*"])
    assert low.stats()["filtered"] == 3 and low.stats()["findings"] == 1
    assert not api.scan(spark, result.config.root, ignore_rules=["*"], entropy=False).failed()


def test_json_csv_markdown(result):
    j = json.loads(result.render("json"))
    assert j["contract_version"] == 1 and list(j["findings"][0]) == list(reports.JSON_FIELDS) and j["scan"]["findings"] == 5
    rows = list(csv.reader(io.StringIO(result.render("csv"))))
    assert rows[0] == list(reports.CSV_FIELDS) and len(rows) == 6 and "\r\n" in result.render("csv")
    assert SECRET not in "".join(result.render(f) for f in ("json", "csv", "markdown", "table", "sarif", "cache-json"))
    assert "## CRITICAL" in result.render("markdown") and "1 critical" in result.render("table")


def test_sarif(result):
    run = json.loads(result.render("sarif"))["runs"][0]
    rules = run["tool"]["driver"]["rules"]
    assert [r["id"] for r in rules][0] == "python.pickle-loads" and rules[0]["name"] == "PythonPickleLoads" and "external/cwe/cwe-502" in rules[0]["properties"]["tags"]
    assert all(rules[x["ruleIndex"]]["id"] == x["ruleId"] for x in run["results"]) and run["results"][0]["locations"][0]["physicalLocation"]["region"]["startColumn"] == 1


def test_cache_merge(result, tmp_path):
    p = tmp_path / "findings.json"
    p.write_text(json.dumps({"findings": [{"store": "scan", "ref": "old"}, {"store": "other", "ref": "kept"}, 5]}))
    result.write_cache(tmp_path)
    rows = json.loads(p.read_text())["findings"]
    assert len(rows) == 6 and rows[-1]["ref"] == "kept" and len(rows[0]) == 25 and rows[0]["id"] == int(rows[0]["fingerprint"][:8], 16) and rows[0]["cvss_score"] is None
    result.write_cache(tmp_path, merge=False)
    assert len(json.loads(p.read_text())["findings"]) == 5
    p.write_text("{broken")
    result.write_cache(tmp_path)


def test_command_line(spark, tmp_path, capfd, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    root = tree(tmp_path / "t", FILES)
    assert cli.main(["scan", str(root), "--format", "json", "--out", str(tmp_path / "o.json")]) == 1 and json.loads((tmp_path / "o.json").read_text())["findings"]
    assert cli.main(["scan", str(root), "--fail-on", "never", "--format", "csv"]) == 0 and "app.py" in capfd.readouterr().out
    assert cli.main(["scan", str(tmp_path / "none")]) == 2 and cli.main(["scan", str(root), "--min-severity", "odd"]) == 2
    assert cli.main(["scan", str(root), "--write-baseline", str(tmp_path / "b.json")]) == 0
    assert cli.main(["scan", str(root), "--baseline", str(tmp_path / "b.json")]) == 0
    assert cli.main(["sync", str(root), "--state-dir", str(tmp_path / "s")]) == 1 and (tmp_path / "s/findings.json").exists()
    capfd.readouterr()
    assert cli.main(["rules", "list"]) == 0 and "81 rules" in capfd.readouterr().out
    assert cli.main(["rules", "validate"]) == 0 and cli.main(["rules", "show", "none"]) == 2
    assert cli.main(["describe"]) == 0 and '"count": 81' in capfd.readouterr().out
    assert cli.main(["init", str(root)]) == 0 and (root / ".sparkwarden.yml").exists()
    (root / ".sparkwarden.yml").write_text("fail_on: low\n")
    cli.main(["init", str(root)])
    assert (root / ".sparkwarden.yml").read_text() == "fail_on: low\n"


def test_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    table(spark, [("a.py", "pickle.loads(x)\n"), ("b.py", "x = 1\n")]).write.parquet(src)
    stream = lambda: streaming.findings(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), ScanConfig(entropy=False))
    streaming.sink(stream(), out, tmp_path / "c").awaitTermination()
    assert spark.read.parquet(out).count() == 1
    table(spark, [("a.py", "\npickle.loads(x)\n"), ("c.py", "pickle.loads(x)\n")]).write.mode("append").parquet(src)
    streaming.sink(stream(), out, tmp_path / "c").awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == ["a.py", "c.py"]


@pytest.mark.parametrize("name", ["rule_hit_positions", "fingerprint_identity", "path_glob_gate", "disposition_counts", "suppressions_line", "entropy_histogram"])
def test_catalogue_agrees_with_sql(spark, tmp_path, name):
    token = "token = \"" + "0123456789abcdef" * 2 + "01234567\""
    rows = [(i, f"Lyly ndsh\n{token} é 10.0.0.{i} a@b.example\nAll rights reserved | 1.2.3.4\n" * (i % 3 + 1) + ("é" * i), "en", f"src{i % 4}", 5) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({catalog.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, got.select(*cols).toPandas().astype(object).itertuples(index=False, name=None))) == sorted(map(str, want)) and len(want)
