import random
import re

from pyspark.sql import functions as F

from sparkwarden import api
from sparkwarden.functions import regex, text
from sparkwarden.operators import entropy, match, native, suppress
from sparkwarden.sources import files
from sparkwarden.sources import rules as R
from sparkwarden.sources.config import ScanConfig

QUIET = ScanConfig(entropy=False, suppressions=False)
SECRET = "aZ3kQ9wLp2Xv7Tn4Rb8Yc1Md6Hs5Jf0G"


def table(spark, rows):
    return spark.createDataFrame([(p, p, p, text.language_of(p), len(t or ""), t, "") for p, t in rows], files.SCHEMA)


def run(spark, rows, rules=None, config=QUIET):
    rules = R.load() if rules is None else rules
    return match.with_rule_texts(match.raw_findings(table(spark, rows), rules, config), rules, config).orderBy("path", "line", "rule_id").collect()


def test_finditer_offsets(spark):
    rng = random.Random(2)
    for p in (r"\w+@\w+", "é+", r"(?i)ab\s*c", "a[^b]*b", r"^\s*x"):
        texts = ["".join(rng.choices(["ab", "c", "é", " ", "\n", "@", "x", "\r", "ñ@b"], k=rng.randint(0, 25))) for _ in range(60)]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", regex.finditer(F.col("t"), regex.to_java(p)).alias("f"))
        for r in df.collect():
            assert [(x.start, x.match) for x in r.f] == [(m.start(), m[0]) for m in regex.compile_rule(p).finditer(texts[r.i])], (p, texts[r.i])


def test_engines_agree(spark):
    rules = [r for r in R.load() if r.engine == "native" and r.examples][:12] + [r for r in R.load() if r.id in ("docker.secret-in-build-arg", "python.hardcoded-password-argument")]
    rows = [(f"{r.id}-{k}.x", r.languages[0], f"\n  {x}\n é\t{x}\n{x} {x}") for r in rules for k, x in enumerate(r.examples + r.counterexamples)]
    rows += [("a", "dockerfile", f"FROM node\n  ENV API_TOKEN={SECRET}\nFROM x:latest\n"), ("b", "python", f"password = '{SECRET}'\r\npassword = '{SECRET}'\x0cpassword='zzzzzzzz9'\n"), ("c", "python", "")]
    df = spark.createDataFrame([(p, p, p, lang, 1, t, "") for p, lang, t in rows], files.SCHEMA)
    key = lambda r: (r.path, r.rule_id, r.line, r.column, r.match, r.snippet, tuple(r.context), r.occurrence, r.fingerprint)
    a, b = native.findings(df, rules).collect(), match.raw_findings(df, rules, QUIET).collect()
    assert sorted(map(key, a)) == sorted(map(key, b)) and len(a) > 20


def test_gates_and_order(spark):
    assert run(spark, [("notes.py", "echo $_GET['x'];")]) == []
    (r,) = run(spark, [("app.py", 'x\n\n   subprocess.run(f"ping {h}", shell=True)\n')])
    assert (r.rule_id, r.line, r.column, r.snippet, r.location) == ("python.subprocess-shell-true", 3, 3, 'subprocess.run(f"ping {h}", shell=True)', "app.py:3")
    assert run(spark, [("a.js", "const app = express()")]) == []
    assert [r.rule_id for r in run(spark, [("a.js", "require('express'); const app = express()")])] == ["js.express-no-helmet"]
    assert run(spark, [("a.js", "require('express'); require('helmet'); const app = express()")]) == []
    assert len(run(spark, [("p.php", '$r = mysqli_query($c, "SELECT 1 WHERE a=" . $_GET["a"]);')])) >= 1


def test_identity_survives_moving_and_tells_copies_apart(spark):
    line = "x = pickle.loads(data)\n"
    one = run(spark, [("a.py", line)])[0]
    moved = run(spark, [("a.py", "\n\n\n" + line)])[0]
    two = run(spark, [("a.py", line * 2)])
    assert one.fingerprint == moved.fingerprint and len({r.fingerprint for r in two}) == 2 and two[0].fingerprint == one.fingerprint
    assert one.key == "scan-" + one.fingerprint[:10] and one.fingerprint != run(spark, [("b.py", line)])[0].fingerprint


def test_no_secret_leaks(spark):
    found = run(spark, [("Dockerfile", f"FROM node:latest\nENV NPM_TOKEN={SECRET}\nRUN x\n"), ("a.py", f'auth_token = "{SECRET}"\nhashlib.md5(b)\n')], config=ScanConfig())
    assert {"docker.latest-tag", "docker.secret-in-build-arg", "secrets.high-entropy-assignment", "python.weak-hash"} <= {r.rule_id for r in found}
    assert not [r for r in found if SECRET in repr(r)]
    long = "k" * 300 + "Q1w2"
    found = run(spark, [("a.py", f"password = '{long}'")])
    assert found and not [r for r in found if "kkkkkkkk" in r.match]


def test_entropy():
    found = list(entropy.candidates(f'auth_token = "{SECRET}"', 4.0))
    assert found == [("auth_token", SECRET, 5.0, 14)]
    for line in (f'auth_token = os.environ["{SECRET}"]', 'auth_token = "' + "ab" * 20 + '"', f'other_name = "{SECRET}"', 'api_key = "your_api_key_goes_here_1234"', 'auth_token = "aaaaaaaaaaaaaaaaaaaaaaab"', 'client_secret = "123e4567-e89b-12d3-a456-426614174000"'):
        assert not list(entropy.candidates(line, 4.0)), line


def test_entropy_natively(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices("abcdef0123456789XYZ", k=rng.randint(1, 60))) for _ in range(100)]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.entropy(F.col("v")).alias("e")).collect()
    assert all(abs(r.e - text.entropy_text(r.v)) < 1e-9 for r in got)


def test_suppressions(spark):
    body = "eval(request.x)  # scan: ignore -- reviewed\n# scan: ignore\neval(request.x)\neval(request.x)  # scan:ignore [js.*]\neval(request.x)  # code-scan: ignore [python.ev*]\n"
    marks = suppress.parse(body)
    assert [marks.find(n, "python.eval-exec") for n in range(1, 6)] == ["reviewed", None, "", None, ""]
    assert suppress.parse("x\n# scan: ignore-file [a.*]\n").find(1, "a.b") == "" and suppress.parse("# scan: ignore-file [a.*]").find(1, "b") is None
    df = table(spark, [("a.py", body), ("b.py", "/* scan: ignore-file: old code */\neval(request.x)")])
    rules = [r for r in R.load() if r.id == "python.eval-exec"]
    want = {(r.path, r.line): (r.suppressed, r.suppressed_by) for r in match.raw_findings(df, rules, ScanConfig()).collect()}
    bare = native.findings(df, rules)
    got = {(r.path, r.line): (r.suppressed, r.suppressed_by) for r in suppress.apply(bare, suppress.table(df)).collect()}
    assert got == want and sum(v[0] for v in got.values()) == 4


def test_partitions_do_not_matter(spark):
    df = table(spark, [(f"m{i}.py", "pickle.loads(x)\nos.system('a' + b)\n") for i in range(60)])
    key = lambda r: r.findings.select("key", "path").collect()
    one, many = (key(api.scan_files(spark, df.repartition(n), ScanConfig())) for n in (1, 7))
    assert one == many and len(one) == 120


def test_lines_and_strip(spark):
    texts = ["", "a", "a\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h", "\n\n", " x  "]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", text.lines(F.col("t")).alias("l"), text.strip(F.col("t")).alias("s")).collect()
    assert all(r.l == texts[r.i].splitlines() and r.s == texts[r.i].strip() for r in got)


def test_long_text_without_a_match_in_the_router(spark):
    body = "subprocess.run(" + "a" * 100_000
    assert run(spark, [("a.py", body)]) == [] and re.match("sub", body)


def test_no_secret_leaks_between_engines(spark):
    """A credential that one engine finds next to a finding of the other is masked in both."""
    rows = [
        ("a.py", f'auth_token = "{SECRET}"\nhashlib.md5(b)\n'),
        ("b.env", f"DATABASE_URL=postgres://user:{SECRET}@db:5432/x\nAPI_TOKEN={SECRET}\n"),
        ("Dockerfile", f"FROM node:latest\nENV NPM_TOKEN={SECRET}\n"),
        ("c.py", f"hashlib.md5(b)\nlogin(password='{SECRET}')\n"),
        ("d.py", 'subprocess.run(f"ping {host}", shell=True)\n'),
    ]
    key = lambda r: tuple(r)
    found = {}
    for engine in ("python", "native"):
        got = api.scan_files(spark, table(spark, rows), ScanConfig(match_engine=engine)).findings.collect()
        assert got and not [r for r in got if SECRET in repr(r)]
        found[engine] = sorted(map(key, got))
    assert found["python"] == found["native"] and any("shell=True" in repr(r) for r in found["native"])


def test_masks(spark):
    values = ["", "a", "12345678", "123456789", "é" * 20]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.mask(F.col("v")).alias("m")).collect()
    assert [r.m for r in got] == list(map(text.mask_text, values)) == ["………"] * 3 + ["1234…[redacted, 9 chars]", "éééé…[redacted, 20 chars]"]


def test_many_matches_in_one_text(spark):
    body = "x1 é\n" * 3000 + "x2"
    got = spark.createDataFrame([(body,)], "t string").select(regex.finditer(F.col("t"), regex.to_java(r"x\d")).alias("f")).first().f
    assert [(m.start, m.feeds, m.column) for m in got] == [(5 * i, i, 0) for i in range(3001)]


def test_engines_number_findings_by_line(spark):
    rules = [r for r in R.load() if r.id in ("docker.secret-in-build-arg", "python.hardcoded-password-argument")]
    rows = [("Dockerfile", "FROM node\n" + f"ENV API_TOKEN={SECRET} API_TOKEN={SECRET}\n" * 2), ("a.py", f"login(password='{SECRET}', password='{SECRET}')\n" * 3)]
    key = lambda r: (r.path, r.rule_id, r.line, r.match, r.occurrence, r.fingerprint)
    df = table(spark, rows)
    a, b = native.findings(df, rules, by_line=True).collect(), match.raw_findings(df, rules, ScanConfig(entropy=False, suppressions=False, number_by_line=True)).collect()
    assert sorted(map(key, a)) == sorted(map(key, b)) and [r.occurrence for r in sorted(a, key=key) if r.path == "a.py"] == [0, 1, 2]
