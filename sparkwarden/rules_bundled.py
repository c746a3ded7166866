"""The bundled rule catalogue.

Fixed values: ids, severities, confidences, categories, CWE numbers, languages
and patterns decide which findings a scan gives, so they are stated as they are.
Patterns are Python regular expressions, case-insensitive and multi-line.
"""

from __future__ import annotations

PY, JS, PHP = ("python",), ("javascript", "typescript"), ("php",)
JVM, SCRIPTS = ("java", "kotlin", "scala"), ("shell", "dockerfile", "make", "yaml")
SUPERGLOBALS = ("$_get", "$_post", "$_request", "$_cookie")

#: OWASP top ten (2021) by category.
OWASP = {
    "injection": "A03:2021 Injection", "xss": "A03:2021 Injection", "deserialization": "A08:2021 Software and Data Integrity Failures", "crypto": "A02:2021 Cryptographic Failures",
    "config": "A05:2021 Security Misconfiguration", "authz": "A01:2021 Broken Access Control", "path-traversal": "A01:2021 Broken Access Control", "csrf": "A01:2021 Broken Access Control",
    "redirect": "A01:2021 Broken Access Control", "ssrf": "A10:2021 Server-Side Request Forgery", "xxe": "A05:2021 Security Misconfiguration", "authn": "A07:2021 Identification and Authentication Failures",
    "secrets": "A07:2021 Identification and Authentication Failures", "files": "A01:2021 Broken Access Control", "supply-chain": "A08:2021 Software and Data Integrity Failures",
}

#: What to do about a finding, by category.
REMEDY = {
    "injection": "Keep data out of the command or statement: bind parameters, pass argument lists, avoid evaluation.", "xss": "Escape on output, or render through a template that escapes by default.",
    "deserialization": "Use a data-only format such as JSON, or a loader that builds no objects.", "crypto": "Use current algorithms and leave certificate checks on.",
    "config": "Turn the unsafe setting off outside development.", "authz": "Check permissions with code that always runs.", "path-traversal": "Resolve the path and require it to lie below a fixed folder.",
    "csrf": "Leave the protection on, or replace it by tokens of your own.", "redirect": "Redirect to known targets only.", "ssrf": "Fetch only from an allow list of hosts.", "xxe": "Disable external entities and document types.",
    "authn": "Verify credentials and sessions with the library's safe defaults.", "secrets": "Rotate the credential, then read it from the environment or a secret store.", "files": "Create files with functions that open them atomically, and check uploads.",
    "supply-chain": "Pin what is fetched and verify it before it runs.",
}


def _rule(id: str, title: str, severity: str, confidence: str, category: str, cwe: int, languages: tuple[str, ...], *patterns: str, **more) -> dict:
    return {"id": id, "title": title, "severity": severity, "confidence": confidence, "category": category, "cwe": cwe, "languages": list(languages), "patterns": list(patterns), "owasp": OWASP[category], "description": f"{title}. The pattern shows the construct, not whether an attacker reaches it.", "remediation": REMEDY[category], "references": [f"https://cwe.mitre.org/data/definitions/{cwe}.html"], "tags": [category]} | {k: list(v) if isinstance(v, tuple) else v for k, v in more.items()}


RULES = [
    # Python
    _rule("python.subprocess-shell-true", "A subprocess runs through the shell", "high", "medium", "injection", 78, PY, r"subprocess\.(?:run|call|check_call|check_output|Popen)\s*\((?:[^()]|\([^()]*\))*shell\s*=\s*True", examples=('subprocess.call("ls " + folder, shell=True)',), counterexamples=('subprocess.call(["ls", folder])',)),
    _rule("python.os-system", "A shell command is put together from parts", "high", "medium", "injection", 78, PY, r"""os\.system\s*\([^)]*(?:%|\+|\.format\(|f["'])""", r"""os\.popen\s*\([^)]*(?:%|\+|\.format\(|f["'])"""),
    _rule("python.eval-exec", "Input reaches eval or exec", "critical", "medium", "injection", 95, PY, r"\beval\s*\([^)]*(?:request|input\(|argv|environ|json|body|param|data)", r"\bexec\s*\([^)]*(?:request|input\(|argv|environ|json|body|param|data)"),
    _rule("python.pickle-loads", "Objects are unpickled", "critical", "medium", "deserialization", 502, PY, r"pickle\.loads?\s*\(", r"cPickle\.loads?\s*\(", r"_pickle\.loads?\s*\(", r"dill\.loads?\s*\(", r"shelve\.open\s*\(", examples=("obj = pickle.load(handle)",), counterexamples=("obj = json.load(handle)",)),
    _rule("python.yaml-unsafe-load", "YAML is loaded with object construction", "critical", "high", "deserialization", 502, PY, r"yaml\.load\s*\((?![^)]*Loader\s*=\s*(?:yaml\.)?(?:Safe|Base|C?Safe)Loader)", r"yaml\.unsafe_load\s*\(", r"yaml\.load_all\s*\((?![^)]*Loader\s*=\s*(?:yaml\.)?Safe)", examples=("yaml.load(body)",), counterexamples=("yaml.safe_load(body)", "yaml.load(body, Loader=yaml.SafeLoader)")),
    _rule("python.sql-string-building", "A SQL statement is built from strings", "high", "medium", "injection", 89, PY, r"""(?:execute|executemany|executescript)\s*\(\s*(?:f["']|["'][^"']*["']\s*(?:%|\+|\.format\())""", r"(?:cursor|conn|db|session)\.execute\s*\([^)]*(?:%\s*\(|\+\s*(?:str\()?(?:request|user|param))", r"""(?:SELECT|INSERT|UPDATE|DELETE)\b[^"'\n]{0,300}["']\s*(?:%|\+)\s*"""),
    _rule("python.django-raw-sql", "Raw SQL of the ORM is built from strings", "high", "medium", "injection", 89, PY, r"""\.raw\s*\(\s*(?:f["']|["'][^"']*["']\s*(?:%|\+|\.format\())""", r"""RawSQL\s*\(\s*(?:f["']|["'][^"']*["']\s*(?:%|\+|\.format\())""", r"""\.extra\s*\([^)]*(?:%|\+|\.format\(|f["'])"""),
    _rule("python.requests-verify-false", "Certificate checks are off", "high", "high", "crypto", 295, PY, r"[(,]\s*verify\s*=\s*False", r"\.verify\s*=\s*False", r"ssl\._create_unverified_context\s*\(", r"ssl\.CERT_NONE", examples=("requests.post(url, verify=False)", "client.verify = False"), counterexamples=("requests.post(url)", "no_verify = False")),
    _rule("python.weak-hash", "A broken hash is used", "medium", "medium", "crypto", 327, PY, r"hashlib\.(?:md5|sha1)\s*\(", r"""hashlib\.new\s*\(\s*["'](?:md5|sha1)["']""", not_patterns=(r"usedforsecurity\s*=\s*False",), examples=("hashlib.sha1(raw)",), counterexamples=("hashlib.sha1(raw, usedforsecurity=False)", "hashlib.sha512(raw)")),
    _rule("python.weak-random-for-secrets", "A secret comes from a predictable generator", "high", "medium", "crypto", 338, PY, r"""(?i)(?:token|secret|password|passwd|salt|nonce|otp|key|session|reset)\w*\s*=\s*(?:["']?\s*)?random\.(?:random|randint|choice|choices|randrange|sample|shuffle)\s*\(""", examples=("reset_code = random.randint(0, 9999)",), counterexamples=("reset_code = secrets.randbelow(9999)",)),
    _rule("python.flask-debug-true", "The web server runs in debug mode", "high", "high", "config", 489, PY, r"app\.run\s*\([^)]*debug\s*=\s*True", r"(?:DEBUG|FLASK_DEBUG)\s*[:=]\s*True", examples=("app.run(port=80, debug=True)",), counterexamples=("app.run(port=80)",)),
    _rule("python.django-debug-true", "Debug pages are on in the settings", "high", "medium", "config", 489, PY, r"^\s*DEBUG\s*=\s*True", paths=("**/settings*.py", "**/settings/*.py", "**/config/*.py")),
    _rule("python.assert-for-authorization", "An assert guards access", "medium", "low", "authz", 617, PY, r"\bassert\s+(?:\w+\.)*(?:is_admin|is_authenticated|is_staff|has_perm|can_|is_owner|user\.is_)"),
    _rule("python.tempfile-mktemp", "A temporary name is used before its file exists", "medium", "high", "files", 377, PY, r"tempfile\.mktemp\s*\(", examples=("name = tempfile.mktemp('.txt')",), counterexamples=("fd, name = tempfile.mkstemp('.txt')",)),
    _rule("python.path-traversal-join", "A path holds request data", "high", "low", "path-traversal", 22, PY, r"(?:open|os\.path\.join|Path)\s*\([^)]*(?:request\.(?:args|form|json|values|GET|POST)|params\[|query_params)", r"send_file\s*\([^)]*(?:request\.|params\[)"),
    _rule("python.xxe-parser", "An XML parser resolves entities", "high", "medium", "xxe", 611, PY, r"etree\.(?:parse|fromstring|XMLParser)\s*\((?![^)]*resolve_entities\s*=\s*False)", r"xml\.dom\.minidom\.parse", r"xml\.sax\.(?:parse|make_parser)"),
    _rule("python.ssrf-request-from-input", "A fetched address holds request data", "high", "low", "ssrf", 918, PY, r"requests\.(?:get|post|put|delete|head|patch|request)\s*\([^)]*(?:request\.(?:args|form|json|values|GET|POST)|params\[)", r"urlopen\s*\([^)]*(?:request\.|params\[)", r"httpx\.(?:get|post|Client)\s*\([^)]*request\."),
    _rule("python.jinja-autoescape-off", "Templates do not escape", "high", "high", "xss", 79, PY, r"autoescape\s*=\s*False", r"Environment\s*\((?![^)]*autoescape)[^)]*loader"),
    _rule("python.hardcoded-password-argument", "A password stands in the code", "high", "low", "secrets", 798, PY, r"""(?i)(?:password|passwd|pwd|secret|token)\s*=\s*["'][^"'\s${}]{6,}["']""", not_patterns=(r"""(?i)(?:example|changeme|your|placeholder|dummy|test|fake|xxx|\.\.\.|password["']|<)""", r"""(?i)password\s*=\s*["'](?:password|secret|123456|admin)["']""", r"os\.environ|getenv|config\[|settings\.|input\(")),
    # JavaScript and TypeScript
    _rule("js.eval-usage", "Input reaches eval or a function constructor", "critical", "medium", "injection", 95, JS, r"\beval\s*\([^)]*(?:req\.|request\.|location|document\.|window\.name|params|query|body|input)", r"new\s+Function\s*\([^)]*(?:req\.|params|query|body|input)"),
    _rule("js.child-process-exec", "A shell command is put together from parts", "high", "medium", "injection", 78, JS, r"""(?:child_process\.)?exec(?:Sync)?\s*\(\s*[`"'][^`"']*\$\{""", r"(?:child_process\.)?exec(?:Sync)?\s*\([^)]*\+\s*(?:req|params|query|body|input|arg)", examples=("exec(`du ${folder}`)",), counterexamples=('execFile("du", [folder])',)),
    _rule("js.dangerously-set-inner-html", "A component sets raw HTML", "high", "medium", "xss", 79, JS, r"""dangerouslySetInnerHTML\s*=\s*\{\{\s*__html:\s*(?!["'`])"""),
    _rule("js.dom-innerhtml-sink", "Text is written to the page as HTML", "high", "low", "xss", 79, JS, r"""\.innerHTML\s*=\s*(?!["'`][^"'`]*["'`]\s*;?\s*$)""", r"""\.outerHTML\s*=\s*(?!["'`])""", r"document\.write(?:ln)?\s*\(", r"\.insertAdjacentHTML\s*\(", not_patterns=(r"""\.innerHTML\s*=\s*["'`]\s*["'`]""", r"DOMPurify|sanitiz"), examples=("box.innerHTML = message",), counterexamples=("box.textContent = message", 'box.innerHTML = ""')),
    _rule("js.sql-template-literal", "A SQL statement is built from strings", "high", "medium", "injection", 89, JS, r"(?:query|execute)\s*\(\s*`[^`]*(?:SELECT|INSERT|UPDATE|DELETE|WHERE)[^`]*\$\{", r"""(?:SELECT|INSERT|UPDATE|DELETE)\b[^"'`\n]{0,300}["'`]\s*\+\s*(?:req|params|query|body|user|id)"""),
    _rule("js.nosql-injection-where", "A document query holds request data", "high", "medium", "injection", 943, JS, r"""\$where\s*:\s*(?:`|["'][^"']*\$\{|[^"'`\s])""", r"\.find\s*\(\s*(?:req\.(?:body|query|params))\s*\)"),
    _rule("js.jwt-verify-disabled", "A signed token is read without verification", "critical", "high", "authn", 347, JS, r"jwt\.decode\s*\((?![^)]*verify)", r"""algorithms\s*:\s*\[[^\]]*["']none["']""", r"ignoreExpiration\s*:\s*true", examples=("jwt.decode(cookie)", 'algorithms: ["HS256", "none"]'), counterexamples=("jwt.verify(cookie, key)",)),
    _rule("js.cors-wildcard-credentials", "Any origin may send credentials", "high", "high", "config", 942, JS, r"""origin\s*:\s*["']\*["'][^}]*credentials\s*:\s*true""", r"""credentials\s*:\s*true[^}]*origin\s*:\s*["']\*["']""", r"""Access-Control-Allow-Origin["']\s*,\s*["']\*"""),
    _rule("js.insecure-random", "A secret comes from a predictable generator", "high", "medium", "crypto", 338, JS, r"(?i)(?:token|secret|password|salt|nonce|otp|key|session|reset|uuid|id)\w*\s*=\s*[^;\n]*Math\.random\s*\(", examples=("const salt = String(Math.random())",), counterexamples=("const salt = crypto.randomBytes(16)",)),
    _rule("js.node-tls-reject-unauthorized", "Certificate checks are off", "high", "high", "crypto", 295, JS, r"rejectUnauthorized\s*:\s*false", r"""NODE_TLS_REJECT_UNAUTHORIZED\s*[=:]\s*["']?0""", examples=("{ rejectUnauthorized: false }",), counterexamples=("{ rejectUnauthorized: true }",)),
    _rule("js.prototype-pollution-merge", "Keys are copied onto an object unchecked", "high", "low", "injection", 1321, JS, r"for\s*\(\s*(?:const|let|var)\s+\w+\s+in\s+\w+\s*\)\s*\{[^}]*\[\s*\w+\s*\]\s*=", r"Object\.assign\s*\(\s*\w+\s*,\s*(?:req\.body|JSON\.parse)", not_patterns=(r"__proto__|hasOwnProperty|Object\.create\(null\)",)),
    _rule("js.express-no-helmet", "A web application sets no security headers", "low", "low", "config", 693, JS, r"express\s*\(\s*\)", requires=r"""require\s*\(\s*["']express|from\s+["']express""", not_requires=r"helmet|X-Frame-Options|contentSecurityPolicy"),
    _rule("js.postmessage-wildcard-origin", "Messages pass between any origins", "medium", "medium", "config", 346, JS, r"""postMessage\s*\([^)]*,\s*["']\*["']""", r"""addEventListener\s*\(\s*["']message["'][^)]*\)\s*(?:=>|\{)(?![^}]*\.origin)"""),
    _rule("js.open-redirect", "A redirect follows request data", "medium", "low", "redirect", 601, JS, r"res\.redirect\s*\([^)]*(?:req\.(?:query|params|body)|\$\{)", r"(?:location\.href|location\.replace|window\.location)\s*=\s*[^;\n]*(?:params\.get|location\.search|location\.hash)"),
    _rule("js.debugger-statement", "A debugger statement is left in", "low", "high", "config", 489, JS, r"^\s*debugger\s*;?\s*$"),
    # PHP
    _rule("php.sql-superglobal-in-query", "Request data stands in a SQL statement", "critical", "high", "injection", 89, PHP, r"(?:mysqli?_query|->query|->exec|pg_query)\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", r"""(?:SELECT|INSERT|UPDATE|DELETE)[^;\n]{0,300}["']\s*\.\s*\$_(?:GET|POST|REQUEST|COOKIE)""", r"(?:SELECT|INSERT|UPDATE|DELETE)[^;\n]{0,300}\{?\$_(?:GET|POST|REQUEST|COOKIE)\[", prefilters=SUPERGLOBALS, examples=('$q = pg_query($db, "SELECT 1 FROM u WHERE n = " . $_POST["n"]);',), counterexamples=('$q = pg_query($db, "SELECT 1");',)),
    _rule("php.sql-string-concat", "A SQL statement is built from strings", "high", "medium", "injection", 89, PHP, r"(?:mysqli?_query|->query|->exec|pg_query)\s*\([^)\n]{0,300}\.\s*\$", r"""\$(?:sql|query|stmt)\s*=\s*["'][^"']*(?:SELECT|INSERT|UPDATE|DELETE)[^"']*["']\s*\.""", prefilters=("_query", "->query", "->exec", "$sql", "$query", "$stmt"), examples=('$db->query("DELETE FROM t WHERE x = " . $x);',)),
    _rule("php.command-execution", "Request data reaches a shell", "critical", "high", "injection", 78, PHP, r"(?:system|exec|shell_exec|passthru|popen|proc_open|pcntl_exec)\s*\([^)\n]{0,300}\$_(?:GET|POST|REQUEST|COOKIE)", r"`[^`\n]{0,300}\$_(?:GET|POST|REQUEST)", prefilters=SUPERGLOBALS, examples=('passthru("du " . $_POST["dir"]);',), counterexamples=('passthru("df");',)),
    _rule("php.file-inclusion", "Request data chooses an included file", "critical", "high", "path-traversal", 98, PHP, r"(?:include|include_once|require|require_once)\s*\(?\s*[^;\n]{0,200}\$_(?:GET|POST|REQUEST|COOKIE)", prefilters=SUPERGLOBALS, examples=('require "lang/" . $_COOKIE["lang"];',), counterexamples=('require "lang/en.php";',)),
    _rule("php.unserialize-user-input", "Request data is unserialised", "critical", "high", "deserialization", 502, PHP, r"unserialize\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", prefilters=("unserialize",), examples=('$cart = unserialize($_POST["cart"]);',), counterexamples=('$cart = json_decode($_POST["cart"]);',)),
    _rule("php.echo-superglobal", "Request data is printed unescaped", "high", "high", "xss", 79, PHP, r"(?:echo|print)\s+[^;\n]{0,300}\$_(?:GET|POST|REQUEST|COOKIE)", r"<\?=\s*\$_(?:GET|POST|REQUEST|COOKIE)", prefilters=SUPERGLOBALS, not_patterns=(r"htmlspecialchars|htmlentities|strip_tags|filter_var|urlencode|json_encode",), examples=('print "Dear " . $_REQUEST["who"];',), counterexamples=('print htmlentities($_REQUEST["who"]);',)),
    _rule("php.weak-crypto", "A broken hash or cipher is used", "medium", "medium", "crypto", 327, PHP, r"\b(?:md5|sha1)\s*\(\s*\$(?:password|passwd|pass|pwd)", r"mcrypt_(?:encrypt|decrypt)\s*\(", r"""["'](?:aes-\d+-)?ecb["']""", prefilters=("md5", "sha1", "mcrypt", "ecb"), examples=("$x = sha1($passwd);", "mcrypt_decrypt($c);"), counterexamples=("$x = password_hash($passwd, PASSWORD_BCRYPT);",)),
    _rule("php.md5-password-comparison", "A secret is compared in variable time", "medium", "medium", "crypto", 208, PHP, r"(?:if|while)\s*\([^)\n]{0,200}\$(?:password|passwd|hash|token|signature|sig)\w*\s*(?:===?|!==?)\s*", prefilters=("$password", "$passwd", "$hash", "$token", "$signature", "$sig"), not_patterns=(r"hash_equals|password_verify",), examples=("if ($token == $given) {",), counterexamples=("if (hash_equals($token, $given)) {",)),
    _rule("php.display-errors-on", "Errors are shown to visitors", "medium", "high", "config", 209, PHP, r"""ini_set\s*\(\s*["']display_errors["']\s*,\s*["']?(?:1|on|true)""", r"error_reporting\s*\(\s*E_ALL\s*\)"),
    _rule("php.file-upload-no-validation", "An upload is stored unchecked", "high", "medium", "files", 434, PHP, r"move_uploaded_file\s*\([^)]*\)", not_requires=r"finfo|mime_content_type|getimagesize|pathinfo"),
    _rule("php.header-injection", "Request data stands in a header", "medium", "medium", "injection", 113, PHP, r"header\s*\([^)]*\$_(?:GET|POST|REQUEST|COOKIE)", prefilters=SUPERGLOBALS, examples=('header("X-Name: " . $_GET["name"]);',), counterexamples=('header("X-Name: none");',)),
    _rule("php.eval-usage", "Code is evaluated from a string", "critical", "high", "injection", 95, PHP, r"eval\s*\([^)]*\$", r"assert\s*\(\s*\$", r"create_function\s*\(", r"""preg_replace\s*\(\s*["'][^"']*/[a-zA-Z]*e[a-zA-Z]*["']""", prefilters=("eval", "assert", "create_function", "preg_replace"), examples=("eval($code);", 'create_function("$x", "return 1;");'), counterexamples=("$y = 2;",)),
    _rule("php.session-fixation", "A login keeps the session id", "medium", "low", "authn", 384, PHP, r"session_start\s*\(\s*\)", requires=r"(?i)login|signin|authenticate", not_requires=r"session_regenerate_id"),
    _rule("php.insecure-cookie", "A cookie lacks its protections", "medium", "medium", "config", 1004, PHP, r"setcookie\s*\([^)]*\)", r"""session\.cookie_httponly\s*[,=]\s*["']?0""", not_patterns=(r"""httponly.*true|true.*httponly|["']samesite["']""",)),
    # Java, Kotlin, Scala, Go, C#, Ruby
    _rule("java.sql-concatenation", "A SQL statement is built from strings", "high", "medium", "injection", 89, JVM, r"(?:createStatement|executeQuery|executeUpdate|execute)\s*\([^)]*\+\s*\w", r'(?:SELECT|INSERT|UPDATE|DELETE)\b[^"]*"\s*\+\s*\w', r'createQuery\s*\(\s*"[^"]*"\s*\+'),
    _rule("java.deserialization", "Objects are read from a stream", "critical", "medium", "deserialization", 502, JVM, r"new\s+ObjectInputStream\s*\(", r"\.readObject\s*\(\s*\)", r"XMLDecoder\s*\(", examples=("Object o = in.readObject();",), counterexamples=("int o = in.readInt();",)),
    _rule("java.runtime-exec", "A command is put together from parts", "high", "medium", "injection", 78, JVM, r"Runtime\.getRuntime\s*\(\s*\)\s*\.exec\s*\([^)]*\+", r"ProcessBuilder\s*\([^)]*\+\s*\w"),
    _rule("java.xxe-parser", "An XML parser resolves entities", "high", "medium", "xxe", 611, JVM, r"DocumentBuilderFactory\.newInstance\s*\(\s*\)", r"SAXParserFactory\.newInstance\s*\(\s*\)", r"XMLInputFactory\.newInstance\s*\(\s*\)", not_requires=r"setFeature|XMLConstants\.FEATURE_SECURE_PROCESSING|setExpandEntityReferences"),
    _rule("java.trust-all-certificates", "Any certificate is accepted", "critical", "high", "crypto", 295, JVM, r"checkServerTrusted\s*\([^)]*\)\s*(?:throws [\w.]+\s*)?\{\s*\}", r"ALLOW_ALL_HOSTNAME_VERIFIER", r"setHostnameVerifier\s*\([^)]*return\s+true"),
    _rule("java.weak-cipher", "A broken cipher or hash is used", "high", "high", "crypto", 327, JVM, r'Cipher\.getInstance\s*\(\s*"(?:DES|DESede|RC2|RC4|Blowfish)', r'Cipher\.getInstance\s*\(\s*"[^"]*/ECB/', r'MessageDigest\.getInstance\s*\(\s*"(?:MD5|SHA-?1)"'),
    _rule("java.spring-csrf-disabled", "Request forgery protection is off", "high", "high", "csrf", 352, ("java", "kotlin"), r"csrf\s*\(\s*\)\s*\.disable\s*\(\s*\)"),
    _rule("go.sql-concatenation", "A SQL statement is built from strings", "high", "medium", "injection", 89, ("go",), r"(?:Query|QueryRow|Exec)(?:Context)?\s*\(\s*(?:[^,)]*,\s*)?fmt\.Sprintf\s*\(", r'(?:Query|QueryRow|Exec)(?:Context)?\s*\([^)]*"\s*\+\s*\w'),
    _rule("go.command-injection", "A shell command is put together from parts", "high", "medium", "injection", 78, ("go",), r'exec\.Command(?:Context)?\s*\(\s*"(?:sh|bash|zsh|cmd)"\s*,\s*"-c"', r"exec\.Command(?:Context)?\s*\([^)]*fmt\.Sprintf"),
    _rule("go.tls-insecure-skip-verify", "Certificate checks are off", "high", "high", "crypto", 295, ("go",), r"InsecureSkipVerify\s*:\s*true", examples=("InsecureSkipVerify:true",), counterexamples=("InsecureSkipVerify: strict",)),
    _rule("go.weak-random", "A secret comes from a predictable generator", "high", "medium", "crypto", 338, ("go",), r"(?i)(?:token|secret|key|password|salt|nonce|session)\w*\s*(?::=|=)\s*[^;\n]*rand\.(?:Int|Intn|Int31|Int63|Float|Read|Perm)", not_patterns=(r"crypto/rand",)),
    _rule("csharp.sql-concatenation", "A SQL statement is built from strings", "high", "medium", "injection", 89, ("csharp",), r'new\s+Sql(?:Command|DataAdapter)\s*\(\s*(?:"[^"]*"\s*\+|\$")', r'CommandText\s*=\s*(?:"[^"]*"\s*\+|\$")'),
    _rule("csharp.binary-formatter", "Objects are read by an unsafe formatter", "critical", "high", "deserialization", 502, ("csharp",), r"new\s+BinaryFormatter\s*\(", r"LosFormatter|NetDataContractSerializer|SoapFormatter", examples=("var f = new BinaryFormatter();",), counterexamples=("var f = JsonSerializer.Serialize(x);",)),
    _rule("ruby.sql-interpolation", "A SQL statement holds interpolated data", "high", "medium", "injection", 89, ("ruby",), r'(?:where|find_by_sql|execute|select_all)\s*\(\s*"[^"]*#\{', r'where\s*\(\s*"[^"]*"\s*\+'),
    _rule("ruby.command-interpolation", "A shell command holds interpolated data", "high", "medium", "injection", 78, ("ruby",), r"`[^`]*#\{", r'system\s*\(\s*"[^"]*#\{', r"(?:%x|exec|spawn)\s*[\(\{][^)}]*#\{"),
    _rule("ruby.yaml-unsafe-load", "Objects are loaded from YAML or Marshal", "critical", "high", "deserialization", 502, ("ruby",), r"YAML\.(?:unsafe_)?load\s*\((?![^)]*safe)", r"Marshal\.load\s*\(", examples=("YAML.load(cookie)",), counterexamples=("YAML.safe_load(cookie)",)),
    # shell, containers, infrastructure, configuration
    _rule("shell.curl-pipe-shell", "A download runs unseen", "high", "high", "supply-chain", 494, SCRIPTS, r"curl\s[^|]*\|\s*(?:sudo\s+)?(?:ba|z|k|d)?sh", r"wget\s[^|]*\|\s*(?:sudo\s+)?(?:ba|z|k|d)?sh", examples=("wget -qO- https://example.org/setup | bash",), counterexamples=("wget -q https://example.org/setup",)),
    _rule("shell.insecure-download", "A download skips certificate checks", "high", "high", "crypto", 295, SCRIPTS, r"curl\s(?:[^|\n]*\s)?-k\b", r"curl\s[^|\n]*--insecure\b", r"wget\s[^|\n]*--no-check-certificate\b", examples=("curl --insecure https://example.org/a",), counterexamples=("curl https://example.org/a",)),
    _rule("shell.unquoted-variable-expansion", "A file command expands an unquoted variable", "medium", "low", "injection", 78, ("shell",), r"(?:rm|mv|cp|chmod|chown|eval|dd)\s+(?:-\w+\s+)*\$(?:\{)?\w+", not_patterns=(r'"\$',)),
    _rule("shell.eval-usage", "A script evaluates a variable", "medium", "medium", "injection", 78, ("shell",), r"^\s*eval\s+[^\n]*\$"),
    _rule("docker.run-as-root", "The image runs as root", "medium", "medium", "config", 250, ("dockerfile",), r"^\s*FROM\s+", requires=r"^\s*(?:RUN|CMD|ENTRYPOINT)", not_requires=r"^\s*USER\s+"),
    _rule("docker.latest-tag", "The base image floats", "low", "high", "supply-chain", 1104, ("dockerfile",), r"^\s*FROM\s+\S+:latest", r"^\s*FROM\s+[a-z0-9._/\-]+\s*(?:AS\s|$)", examples=("FROM debian:latest",), counterexamples=("FROM debian:12.5-slim",)),
    _rule("docker.secret-in-build-arg", "A credential is baked into the image", "high", "medium", "secrets", 798, ("dockerfile",), r"^\s*ARG\s+\w*(?:SECRET|PASSWORD|TOKEN|KEY|CREDENTIAL)\w*\s*=", r"^\s*ENV\s+\w*(?:SECRET|PASSWORD|TOKEN|APIKEY|API_KEY)\w*[\s=]+\S+", not_patterns=(r"(?:=\s*$|\$\{|example|changeme|placeholder)",)),
    _rule("docker.privileged-compose", "A container gets the host's rights", "high", "high", "config", 250, ("yaml",), r"^\s*privileged\s*:\s*true", r"""^\s*network_mode\s*:\s*["']?host""", r"""^\s*pid\s*:\s*["']?host""", r"/var/run/docker\.sock", paths=("**/docker-compose*.y*ml", "**/compose*.y*ml")),
    _rule("k8s.privileged-container", "A pod gets the host's rights", "high", "medium", "config", 250, ("yaml",), r"^\s*privileged\s*:\s*true", r"^\s*allowPrivilegeEscalation\s*:\s*true", r"^\s*runAsNonRoot\s*:\s*false", r"^\s*hostNetwork\s*:\s*true", requires=r"(?m)^\s*(?:apiVersion|kind)\s*:"),
    _rule("k8s.secret-in-manifest", "A credential stands in a manifest", "high", "medium", "secrets", 798, ("yaml",), r"""(?m)^\s*(?:password|passwd|token|apiKey|api_key|secretKey|privateKey)\s*:\s*(?!["']?\s*(?:\$|\{\{|valueFrom|secretKeyRef))["']?[A-Za-z0-9+/=_\-]{8,}""", requires=r"(?m)^\s*kind\s*:"),
    _rule("terraform.public-ingress", "A port is open to everyone", "high", "medium", "config", 284, ("terraform",), r"""cidr_blocks\s*=\s*\[\s*["']0\.0\.0\.0/0["']""", examples=('cidr_blocks = [ "0.0.0.0/0" ]',), counterexamples=('cidr_blocks = ["192.168.0.0/16"]',)),
    _rule("terraform.unencrypted-storage", "Storage is not encrypted", "medium", "medium", "crypto", 311, ("terraform",), r"storage_encrypted\s*=\s*false", r"encrypted\s*=\s*false", r"skip_final_snapshot\s*=\s*true"),
    _rule("terraform.public-bucket", "A bucket is open to everyone", "high", "medium", "config", 284, ("terraform",), r"""acl\s*=\s*["']public-read(?:-write)?["']""", r"block_public_acls\s*=\s*false", r"restrict_public_buckets\s*=\s*false", examples=('acl = "public-read-write"',), counterexamples=('acl = "log-delivery-write"',)),
    _rule("ci.pull-request-target-checkout", "A privileged workflow checks out foreign code", "critical", "medium", "supply-chain", 269, ("yaml",), r"pull_request_target", paths=("**/.github/workflows/*.y*ml",), requires=r"(?m)ref:\s*\$\{\{\s*github\.event\.pull_request\.head"),
    _rule("ci.unpinned-action", "A workflow action floats", "low", "medium", "supply-chain", 1357, ("yaml",), r"(?m)uses:\s*[\w.\-]+/[\w.\-]+@v?\d+(?:\.\d+)*\s*$", paths=("**/.github/workflows/*.y*ml",)),
    _rule("config.directory-listing", "Directories are listed", "low", "high", "config", 548, ("apache", "nginx", "ini"), r"Options\s+[^\n]*\+?Indexes", r"autoindex\s+on"),
    _rule("config.tls-old-protocol", "An old transport protocol is on", "high", "high", "crypto", 327, ("nginx", "apache", "ini", "yaml", "terraform"), r"ssl_protocols[^;\n]*(?:SSLv2|SSLv3|TLSv1(?:\.0|\.1)?)\b", r"SSLProtocol[^\n]*(?:SSLv2|SSLv3|TLSv1(?:\.0|\.1)?)\b", r"""minimum_protocol_version\s*=\s*["']?TLSv1(?:\.0|\.1)?["']?"""),
]
