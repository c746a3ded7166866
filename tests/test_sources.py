import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkwarden import api
from sparkwarden.errors import ConfigError, TargetError
from sparkwarden.functions import text
from sparkwarden.sources import config, files, git, known

SINK = "pickle.loads(x)\n"


def tree(root, content):
    for name, body in content.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body if isinstance(body, bytes) else body.encode())
    return root


def paths(r):
    return sorted(x.path for x in r.findings.select("path").collect())


def test_tree_with_hidden_binary_large_and_excluded(spark, tmp_path):
    tree(tmp_path, {"a.py": SINK, ".github/x.py": SINK, "_u.py": SINK, "node_modules/m.py": SINK, "b.py": b"\0" + SINK.encode(), "c.py": SINK * 50, "d.png": "x", "e.py": b"\xff" + SINK.encode()})
    r = api.scan(spark, tmp_path, max_file_bytes=400)
    assert paths(r) == [".github/x.py", "_u.py", "a.py", "e.py"]
    s = r.stats()
    assert (s["files_scanned"], s["skipped_binary"], s["skipped_large"], s["skipped_unknown"], s["skipped_excluded"]) == (4, 1, 1, 1, 1)
    assert paths(api.scan(spark, tmp_path, include=["_*"])) == ["_u.py"]
    assert paths(api.scan(spark, tmp_path / "a.py")) == ["a.py"]


def test_git(spark, tmp_path):
    with pytest.raises(TargetError):
        git.changed(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    run("init", "-q")
    tree(tmp_path, {"sub/a.py": SINK, "skip.py": SINK, ".gitignore": "skip.py\n"})
    run("add", "-A")
    run("commit", "-qm", "one")
    tree(tmp_path, {"sub/b.py": SINK})
    run("add", "-A")
    assert paths(api.scan(spark, tmp_path)) == ["sub/a.py", "sub/b.py"]
    assert paths(api.scan(spark, tmp_path, respect_gitignore=False)) == ["skip.py", "sub/a.py", "sub/b.py"]
    assert paths(api.scan(spark, tmp_path, diff="HEAD")) == ["sub/b.py"] == paths(api.scan(spark, tmp_path, staged=True))
    assert paths(api.scan(spark, tmp_path / "sub", diff="HEAD")) == ["b.py"]
    assert [r.project_path for r in files.read_tree(spark, config.ScanConfig(root=str(tmp_path / "sub"))).collect()] == ["sub/a.py", "sub/b.py"]


@pytest.mark.parametrize("name,want", [("b.py", "python"), ("Dockerfile", "dockerfile"), ("x/Dockerfile.web", "dockerfile"), (".env.production", "env"), ("main.tf", "terraform"), ("photo.png", ""), ("a.conf.bak", "ini"), ("nginx.conf", "nginx"), (".npmrc", "ini"), ("README", ""), ("A.TSX", "typescript")])
def test_languages(spark, name, want):
    assert text.language_of(name) == want and spark.range(1).select(text.language(F.lit(name))).first()[0] == want


def test_baselines(spark, tmp_path):
    p = tmp_path / "b.json"
    for data, want in ((["a"], ["a"]), ({"fingerprints": ["b", {"fingerprint": "a"}]}, ["a", "b"]), ({"findings": [{"fingerprint": "c"}, 4]}, ["c"]), ("x", [])):
        p.write_text(json.dumps(data))
        assert known.fingerprints(p) == want
    p.write_text("{broken")
    assert known.fingerprints(p) == [] and known.baseline(spark, p).count() == 0
    root = tree(tmp_path / "t", {"a.py": SINK})
    p.write_text(api.scan(spark, root).render("baseline"))
    tree(root, {"b.py": SINK})
    r = api.scan(spark, root, baseline=str(p))
    assert paths(r) == ["b.py"] and r.stats()["baselined"] == 1


def test_config(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / ".sparkwarden.yml").write_text("min_severity: high\nexclude: [x/**]\nentropy: 'no'\nrule_dirs: [r]\n")
    (tmp_path / "r").mkdir()
    c = config.load(tmp_path).merge(exclude=["y"], fail_on=None)
    assert (c.min_severity, c.exclude, c.entropy, c.rule_dirs, c.fail_on) == ("high", ("x/**", "y"), False, (str(tmp_path / "r"),), "high")
    with pytest.raises(ConfigError) as e:
        c.merge(min_severity="never", entropy_threshold=9.0, fail_on="x").check()
    assert all(k in str(e.value) for k in ("min_severity", "entropy_threshold", "fail_on"))
    (tmp_path / ".sparkwarden.yml").write_text("colour: red\n")
    with pytest.raises(ConfigError, match="colour"):
        config.load(tmp_path)
