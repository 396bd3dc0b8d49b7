"""HTTP clients, routes, mounts and test observations: joins and column functions over extract.calls.

`rows` is what `parsed(source_files)` gives. Endpoints go out as operators.radar takes them. What
cannot be told from the text, a URL that is no literal or a receiver that is not found, is a row of
`unknowns`, not a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larchgraph.extract import calls as C
from larchgraph.functions import paths as P
from larchgraph.functions.tables import stored
from larchgraph.operators import names as N
from larchgraph.operators import radar as R

# HTTP verbs, the words that make a middleware an authentication check, and decorators.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
AUTH_WORDS = r"(?i)(?:^|\W)(?:\w*auth\w*|guard|require\w*user|verify\w*token)(?:\W|$)"
AUTH_DECORATORS = ("useguards", "auth", "authenticated", "requireauth")
TYPED = r"(?i)[(,]\s*(app|router|server|fastify)\s*\??\s*:\s*([^,)=]*(?:Express|Router|FastifyInstance)[^,)=]*)"
KEY = ["project_id", "path"]
ENDPOINT = ["project_id", "id", "side", "method", "path", "file", "line", "framework", "confidence", "request_fields", "response_fields", "statuses", "auth"]
_STRINGS, _INTS = "array<string>", "array<int>"


def first_paths(files: DataFrame) -> DataFrame:
    """(project_id, path, content) at normal paths. Of equal paths the first stays: by `ordinal` if
    there is one, else by the path as given and the content."""
    first = ["ordinal"] if "ordinal" in files.columns else []
    df = files.filter("path is not null").select("project_id", P.normal_path(F.col("path")).alias("path"), F.struct(*first, F.col("path").alias("p"), F.coalesce("content", F.lit("")).alias("content")).alias("f"))
    return df.groupBy(*KEY).agg(F.min("f").alias("f")).select(*KEY, F.col("f.content").alias("content"))


def scripts(files: DataFrame) -> DataFrame:
    """Script files, without declarations."""
    return first_paths(files).filter(F.col("path").rlike(P.SCRIPT_NAME) & ~F.col("path").rlike(P.DECLARATION))


def parsed(files: DataFrame) -> DataFrame:
    """The rows of the script files, written once; they are read by every extraction below."""
    return stored(C.extract(scripts(files)))


def _calls(rows: DataFrame) -> DataFrame:
    return rows.filter("fact = 'call'").select(*KEY, "pos", "line", F.lower("name").alias("verb"), "name", "receiver", "args", "assigned", "scope", "last")


def url_of(text: Column) -> Column:
    """struct(path, confidence) of a literal or template as it stands in the source, else null."""
    quoted = F.lit(r"^(['\"`])[\s\S]*\1$")

    def of(u: Column) -> Column:
        whole = F.substring(u, F.lit(2), F.length(u) - 2)
        open_ = u.startswith("`") & whole.contains("${")
        path = P.http_path(F.when(open_, F.regexp_replace(whole, r"\$\{[^}]*\}", ":dynamic")).otherwise(whole))
        return F.when(F.regexp_like(u, quoted) & path.isNotNull(), F.struct(path.alias("path"), F.when(open_, "pattern").otherwise("exact").alias("confidence")))

    return F.get(F.transform(F.array(text), of), F.lit(0))


def _literal(text: Column) -> Column:
    """A quoted text without its quotes, else null."""
    return F.when(text.rlike(r"^(['\"])[^'\"]*\1$|^`[^`$]*`$"), F.substring(text, F.lit(2), F.length(text) - 2))


def _argument_url(n: int) -> Column:
    a = F.get("args", F.lit(n))
    return F.when(a["kind"].isin("literal", "template"), url_of(a["text"]))


def _sorted(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(names, F.array().cast(_STRINGS))))


def _names(argument: Column) -> Column:
    return _sorted(F.when(argument["kind"] == "object", argument["names"]))


def _endpoints(df: DataFrame, side: str) -> DataFrame:
    df = df.withColumn("id", F.concat_ws(":", F.lit(side), "method", "http", "path", "line", "pos"))
    return df.select("project_id", "id", F.lit(side).alias("side"), "method", F.col("http").alias("path"), F.col("path").alias("file"), "line", "framework", "confidence", "request_fields", "response_fields", "statuses", "auth")


def _found(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """A row for each match in the files' texts without comments, with its groups by name."""
    files = rows.filter("fact = 'file'").select(*KEY, F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("_m"))
    return files.select(*KEY, *[F.regexp_extract("_m", pattern, i + 1).alias(n) for i, n in enumerate(names) if n])


# --- clients --------------------------------------------------------------------------------------


def _axios(rows: DataFrame) -> DataFrame:
    """(project_id, path, receiver, base): the file's axios clients."""
    imported = _found(rows, r"\bimport\s+(?:\*\s*as\s+)?([\w$]+)\s*(?:,\s*\{[^}]*\}\s*)?from\s*['\"]axios['\"]", ["receiver"])
    texts = rows.filter("fact = 'file'").filter(~F.col("text").rlike(r"\b(?:const|let|var)\s+axios\b"))
    roots = imported.unionByName(texts.select(*KEY, F.lit("axios").alias("receiver"))).distinct()
    base = F.coalesce(_literal(F.get("args", F.lit(0))["props"]["baseURL"]), F.lit(""))
    made = _calls(rows).filter("name = 'create' and assigned is not null").join(roots, [*KEY, "receiver"], "left_semi").select(*KEY, F.col("assigned").alias("receiver"), base.alias("base"))
    return roots.withColumn("base", F.lit("")).unionByName(made).groupBy(*KEY, "receiver").agg(F.max("base").alias("base"))


def _requests(rows: DataFrame) -> DataFrame:
    return _once(rows, "requests", lambda: _requesting(rows))


def _requesting(rows: DataFrame) -> DataFrame:
    """fetch and axios calls with framework, method, url and base; method or url is null where unknown."""
    c = _calls(rows)
    options = F.get("args", F.lit(1))
    named = F.upper(_literal(options["props"]["method"]))
    known = F.when(named.isNotNull(), F.when(F.lower(named).isin(*VERBS), named)).when((options["kind"] == "object") & ~F.array_contains(options["names"], "method"), "GET")
    method = F.when(F.size("args") < 2, "GET").otherwise(known)
    fetched = c.filter("name = 'fetch' and receiver is null").withColumns({"framework": F.lit("fetch"), "method": method, "base": F.lit("")})
    ax = c.filter(F.col("verb").isin(*VERBS)).join(_axios(rows), [*KEY, "receiver"]).withColumns({"framework": F.lit("axios"), "method": F.upper("verb")})
    return fetched.unionByName(ax.select(*fetched.columns)).withColumn("url", _argument_url(0))


def _client_auth(options: Column) -> Column:
    headers = options["props"]["headers"]
    in_object = F.when(headers.rlike(r"(?i)[{,]\s*['\"]?authorization['\"]?\s*[:,}]"), "present").otherwise("absent")
    of_object = F.when(headers.isNull(), "absent").when(headers.startswith("{"), in_object).otherwise("unknown")
    return F.when(options.isNull(), "absent").when(options["kind"] != "object", "unknown").otherwise(of_object)


def _expected(kind: str) -> Column:
    """What the code after an assigned call reads of its response: fields, or statuses compared with."""
    var = F.concat(F.lit(r"\b"), F.replace("assigned", F.lit("$"), F.lit(r"\$")))
    every = lambda *parts: F.regexp_extract_all("scope", F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(1))
    field = r"\s*\.\s*([$A-Z_a-z][$\w]*)"
    if kind == "statuses":
        found = every(var, r"\s*\.\s*status\s*(?:===|==)\s*(\d{3})").cast(_INTS)
        return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast(_INTS))))
    bodies = every(r"([\w$]+)\s*(?::[^=;]+)?=\s*\(?\s*(?:await\s+)?", var, r"\s*\.\s*json\(\)")
    of_fetch = F.flatten(F.transform(bodies, lambda n: F.regexp_extract_all(F.col("scope"), F.concat(F.lit(r"\b"), F.replace(n, F.lit("$"), F.lit(r"\$")), F.lit(field)), F.lit(1))))
    return _sorted(F.when(F.col("framework") == "axios", every(var, r"\s*\.\s*data", field)).otherwise(of_fetch))


def _with_body(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with request_fields: keys of the object that a request sends."""
    sent = _calls(rows).filter("name = 'stringify'").select(*KEY, F.col("pos").alias("_at"), _names(F.get("args", F.lit(0))).alias("_keys"))
    options = F.get("args", F.lit(1))
    inside = F.col("_at").between(options["first"], options["last"]) & F.coalesce(options["props"]["body"].rlike(r"^[\w$.]+\.stringify\("), F.lit(False))
    opts = df.filter("framework = 'fetch'").alias("d").join(sent.alias("s"), KEY).filter(inside).groupBy(*KEY, "pos").agg(F.min_by("_keys", "_at").alias("_keys"))
    df = df.join(opts, [*KEY, "pos"], "left")
    flat = F.transform(F.split(F.regexp_extract(F.coalesce(options["props"]["body"], F.lit("")), r"^\{([\s\S]*)\}$", 1), ","), lambda x: F.regexp_extract(x, r"^\s*['\"]?([A-Za-z_$][\w$]*)['\"]?\s*(?::|$)", 1))
    of_fetch = F.coalesce("_keys", F.filter(flat, lambda x: x != ""))
    of_axios = F.when(F.col("method").isin("POST", "PUT", "PATCH"), _names(options))
    return df.withColumn("request_fields", _sorted(F.when(F.col("framework") == "fetch", of_fetch).otherwise(of_axios))).drop("_keys")


def _client_rows(rows: DataFrame, tests: bool) -> DataFrame:
    df = _requests(rows).filter(P.is_test(F.col("path")) == F.lit(tests)).filter("url is not null and method is not null")
    df = _with_body(df, rows)
    n = F.when((F.col("framework") == "fetch") | ~F.col("method").isin("POST", "PUT", "PATCH"), 1).otherwise(2)
    base = F.coalesce(P.http_path(F.col("base")), F.lit("/"))
    return df.withColumns({
        "http": F.when(F.col("base") == "", F.col("url.path")).otherwise(P.join_http(base, F.col("url.path"))), "confidence": F.col("url.confidence"),
        "response_fields": _expected("fields"), "statuses": _expected("statuses"), "auth": _client_auth(F.get("args", n)),
    })


def clients(rows: DataFrame) -> DataFrame:
    """Calls by fetch and axios outside test files."""
    return _endpoints(_client_rows(rows, False), "client")


def observations(rows: DataFrame) -> DataFrame:
    """(project_id, id, method, path, file, line): calls in test files, by clients there and by
    request(app).verb(path)."""
    own = _client_rows(rows, True).select(*KEY, "line", "method", "http", F.lit(None).cast("int").alias("pos"))
    asked = _calls(rows).filter(P.is_test(F.col("path")) & F.col("verb").isin(*VERBS) & F.col("receiver").rlike(r"^(request|supertest)\(.*\)$"))
    asked = asked.select(*KEY, "line", F.upper("verb").alias("method"), _argument_url(0)["path"].alias("http"), "pos").filter("http is not null")
    every = own.unionByName(asked)
    return every.select("project_id", F.concat_ws(":", F.lit("test"), "method", "http", "path", "line", "pos").alias("id"), "method", F.col("http").alias("path"), F.col("path").alias("file"), "line")


# --- receivers and what names stand for --------------------------------------------------------------


def receivers(rows: DataFrame) -> DataFrame:
    """(project_id, path, var, framework): variables and parameters that hold an application or router."""
    return _once(rows, "receivers", lambda: _receivers(rows))


def _receivers(rows: DataFrame) -> DataFrame:
    made = _calls(rows).filter("assigned is not null and name in ('express', 'Router', 'fastify')")
    made = made.select(*KEY, F.col("assigned").alias("var"), F.when(F.col("name") == "fastify", "fastify").otherwise("express").alias("framework"))
    typed = _found(rows, TYPED, ["var", "type"]).select(*KEY, "var", F.when(F.col("type").contains("Fastify") | (F.lower("var") == "fastify"), "fastify").otherwise("express").alias("framework"))
    bare = _found(rows, r"(?i)[(,]\s*(fastify)\s*[,):=?]", ["var"]).withColumn("framework", F.lit("fastify"))
    return made.unionByName(typed).unionByName(bare).groupBy(*KEY, "var").agg(F.max("framework").alias("framework"))


def links(rows: DataFrame) -> DataFrame:
    """The links of scripts among the rows, as operators.names reads them."""
    return rows.filter("fact = 'link'").select(*KEY, F.col("scope").alias("kind"), "pos", "name", F.col("receiver").alias("spec"), F.col("assigned").alias("symbol"))


def _once(rows: DataFrame, name: str, make) -> DataFrame:
    """What several parts read of the same rows: made once, and written."""
    made = rows.__dict__.setdefault("_made", {})
    if name not in made:
        made[name] = stored(make())
    return made[name]


def _ends(rows: DataFrame) -> DataFrame:
    """Where the names of each file lead; a whole module leads to its default export."""

    def make() -> DataFrame:
        found = N.ends(links(rows), rows.filter("fact = 'file'").select(*KEY).distinct())
        whole = found.withColumn("_e", F.split("end", "\u0001")).filter("_e[0] = 'M'").select("project_id", F.col("node").alias("_from"), N.node("E", F.col("_e")[1], F.lit("default")).alias("node"))
        on = N.at_end(whole, "node", found).select("project_id", F.col("_from").alias("node"), F.concat_ws("\u0001", "kind", "at", "of").alias("end"))
        return found.filter(~F.col("end").startswith("M")).unionByName(on)

    return _once(rows, "ends", make)


def _bound(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """(project_id, path, name, key): names of a file that stand for a key of keys(project_id, path,
    name, key), of the file itself or over imports, re-exports and aliases of any length. A default export
    without a name has the name `default`."""
    led = _ends(rows).filter(F.col("node").startswith("L")).select("project_id", F.split("node", "\u0001").alias("_n"), F.split("end", "\u0001").alias("_e"))
    led = led.select("project_id", F.col("_n")[1].alias("path"), F.col("_n")[2].alias("name"), F.col("_e")[1].alias("at"), F.col("_e")[2].alias("of"))
    there = keys.select("project_id", F.col("path").alias("at"), F.col("name").alias("of"), "key")
    far = led.join(there, ["project_id", "at", "of"]).select(*KEY, "name", "key")
    return keys.select(*KEY, "name", "key").unionByName(far.join(keys.select(*KEY, "name"), [*KEY, "name"], "left_anti"))


def bindings(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(project_id, path, name, key): what receiver, path#variable, a name stands for."""
    return _once(rows, "bindings", lambda: _bound(rows, held.select(*KEY, F.col("var").alias("name"), F.concat_ws("#", "path", "var").alias("key"))))


def plugins(rows: DataFrame, held: DataFrame) -> DataFrame:
    """(project_id, path, name, key): functions whose first parameter is a receiver."""
    declared = _found(rows, r"\bfunction\s*([\w$]+)\s*\(\s*([\w$]+)", ["name", "var"])
    arrows = _found(rows, r"\b(?:const|let|var)\s+([\w$]+)\s*(?::[^=;]+)?=\s*(?:async\s*)?(?:function\s*)?\(?\s*([\w$]+)\s*[,):=]", ["name", "var"])
    default = _found(rows, r"\bexport\s+default\s+(?:async\s+)?(?:function\s*[\w$]*\s*)?\(\s*([\w$]+)", ["var"]).withColumn("name", F.lit("default"))
    every = declared.unionByName(arrows).unionByName(default.select(declared.columns)).join(held.select(*KEY, "var"), [*KEY, "var"], "left_semi")
    return _bound(rows, every.groupBy(*KEY, "name").agg(F.min(F.concat_ws("#", "path", "var")).alias("key")))


# --- mounts and routes ---------------------------------------------------------------------------------


def _mount_rows(rows: DataFrame) -> DataFrame:
    return _once(rows, "mounts", lambda: _mounting(rows))


def _mounting(rows: DataFrame) -> DataFrame:
    """Mount calls of known parents, with child (null where it is not found), prefix and `told`:
    whether a missing child is worth a row of unknowns."""
    held = receivers(rows)
    known = bindings(rows, held)
    parents = known.select(*KEY, F.col("name").alias("receiver"), F.col("key").alias("parent"))
    calls = _calls(rows).filter("name in ('use', 'register')").join(parents, [*KEY, "receiver"])
    url = _argument_url(0)
    used = calls.filter("name = 'use'").withColumn("_url", url).withColumn("rest", F.when(F.col("_url").isNotNull(), F.slice("args", 2, F.greatest(F.size("args") - 1, F.lit(0)))).otherwise(F.col("args")))
    used = used.withColumns({"prefix": F.coalesce("_url.path", F.lit("/")), "told": F.col("_url").isNotNull() & (F.size("rest") > 0)})
    children = known.select(*KEY, F.col("name").alias("_name"), F.col("key").alias("child"))
    given = used.select(*KEY, "pos", F.posexplode("rest").alias("_n", "_a")).select(*KEY, "pos", "_n", F.col("_a.text").alias("_name"))
    given = given.join(children, [*KEY, "_name"]).groupBy(*KEY, "pos").agg(F.min_by("child", "_n").alias("child"))
    used = used.join(given, [*KEY, "pos"], "left")

    plug = plugins(rows, held).withColumn("_rank", F.lit(0)).unionByName(known.withColumn("_rank", F.lit(1)))
    plug = plug.groupBy(*KEY, F.col("name").alias("_name")).agg(F.min_by("key", "_rank").alias("child"))
    first = F.get("args", F.lit(0))
    inline = F.when(first["kind"] == "function", F.regexp_extract(first["text"], r"^(?:async\s*)?(?:function\b[^(]*)?\(?\s*([\w$]+)", 1))
    own = held.select(*KEY, F.col("var").alias("_param"), F.concat_ws("#", "path", "var").alias("_own"))
    prefix = F.coalesce(P.http_path(_literal(F.get("args", F.lit(1))["props"]["prefix"])), F.lit("/"))
    plugged = calls.filter("name = 'register'").withColumns({"_name": first["text"], "_param": inline, "prefix": prefix, "told": F.size("args") > 0})
    plugged = plugged.join(plug, [*KEY, "_name"], "left").join(own, [*KEY, "_param"], "left").withColumn("child", F.coalesce("child", "_own"))
    cols = [*KEY, "pos", "last", "line", "name", "parent", "child", "prefix", "told"]
    return used.select(*cols).unionByName(plugged.select(*cols))


def mounts(rows: DataFrame) -> DataFrame:
    """(project_id, parent, child, prefix): use() and register() edges between receivers, as path#variable."""
    return _mount_rows(rows).filter("child is not null").select("project_id", "parent", "child", "prefix").distinct()


def _route_calls(rows: DataFrame) -> DataFrame:
    return _once(rows, "routes", lambda: _routing(rows))


def _routing(rows: DataFrame) -> DataFrame:
    """Route calls of known receivers, with url (null where it is no literal)."""
    held = receivers(rows)
    known = bindings(rows, held).select(*KEY, F.col("name").alias("_name"), F.col("key").alias("receiver_key"))
    chain = r"^([\w$]+)\.route\(([^()]*(?:\([^()]*\)[^()]*)*)\)$"
    chained = F.col("receiver").rlike(chain)
    c = _calls(rows).filter(F.col("verb").isin(*VERBS, "all")).withColumn("_name", F.when(chained, F.regexp_extract("receiver", chain, 1)).otherwise(F.col("receiver")))
    c = c.join(known, [*KEY, "_name"]).filter(chained | (F.size("args") >= 2))
    url = F.when(chained, url_of(F.regexp_extract("receiver", chain, 2))).otherwise(_argument_url(0))
    kinds = held.select("project_id", F.concat_ws("#", "path", "var").alias("receiver_key"), "framework")
    between = F.slice("args", F.when(chained, 1).otherwise(2), F.greatest(F.size("args") - F.when(chained, 1).otherwise(2), F.lit(0)))
    c = c.join(kinds, ["project_id", "receiver_key"]).withColumn("url", url)
    guarded = F.exists(between, lambda a: a["text"].rlike(AUTH_WORDS))
    return c.withColumns({"handler": F.get("args", F.size("args") - 1), "auth": F.when(guarded, "required").otherwise("absent")})


def _handled(df: DataFrame, rows: DataFrame, names: tuple[str, str] | None = None) -> DataFrame:
    """df, with a handler (text, first, last), gains what the handler reads and sends."""
    parameter = lambda n: F.nullif(F.regexp_extract("handler.text", r"^(?:async\s*)?(?:function\b[^(]*)?\(?\s*" + r"[^,()]*,\s*" * n + r"([\w$]+)", 1), F.lit(""))
    req, res = (F.coalesce(parameter(n), F.lit(d)) for n, d in ((0, "req"), (1, "res")))
    if names:
        req, res = (F.coalesce(F.col(c), F.lit(d)) for c, d in zip(names, ("req", "res"), strict=True))
    is_function = F.col("handler.kind") == "function"
    df = df.withColumns({"_req": req, "_res": res})
    read = F.regexp_extract_all("handler.text", F.concat(F.lit(r"\b"), F.replace("_req", F.lit("$"), F.lit(r"\$")), F.lit(r"\s*\.\s*body\s*\.\s*([\w$]+)")), F.lit(1))
    df = df.withColumn("request_fields", _sorted(F.when(is_function, read)))
    inner = _calls(rows).filter("name in ('json', 'send', 'status', 'code', 'sendStatus')").select(*KEY, F.col("pos").alias("_at"), F.col("name").alias("_sent"), F.col("receiver").alias("_by"), F.get("args", F.lit(0)).alias("_a"))
    h = df.filter(is_function).select(*KEY, "pos", "handler.first", F.col("handler.last").alias("_end"), "_res").join(inner, KEY)
    h = h.filter((F.col("_at") >= F.col("first")) & (F.col("_at") < F.col("_end")) & ((F.col("_by") == F.col("_res")) | F.col("_by").startswith(F.concat("_res", F.lit("."))) | F.col("_by").startswith(F.concat("_res", F.lit("(")))))
    code = F.when(F.col("_sent").isin("status", "code", "sendStatus") & F.col("_a.text").rlike(r"^[1-9]\d*$"), F.col("_a.text").cast("int"))
    sent = F.col("_sent").isin("json", "send")
    found = h.groupBy(*KEY, "pos").agg(F.flatten(F.collect_set(F.when(sent, _names(F.col("_a"))))).alias("_fields"), F.collect_set(code).alias("_codes"), F.bool_or(sent | (F.col("_sent") == "sendStatus")).alias("_sends"))
    df = df.join(found, [*KEY, "pos"], "left")
    codes = F.coalesce("_codes", F.array().cast(_INTS))
    default = F.when(F.col("_sends") & (F.size(codes) == 0), F.array(F.lit(200))).otherwise(codes)
    return df.withColumns({"response_fields": _sorted(F.col("_fields")), "statuses": F.array_sort(default)}).drop("_req", "_res", "_fields", "_codes", "_sends")


def route_drafts(rows: DataFrame) -> DataFrame:
    """Routes of receivers before mounts."""
    df = _handled(_route_calls(rows).filter("url is not null"), rows)
    verb = F.when(F.col("verb") == "all", "ANY").otherwise(F.upper("verb"))
    return df.withColumns({"method": verb, "http": F.col("url.path"), "confidence": F.col("url.confidence")})


def file_routes(rows: DataFrame) -> DataFrame:
    """Routes named by their file: route.* below the last `app` folder, for each exported method."""
    df = rows.filter("fact = 'export'").filter(F.lower("name").isin(*VERBS) & F.col("path").rlike(r"(?i)(^|/)route\.[cm]?[jt]sx?$") & F.col("path").rlike(r"(^|/)app/"))
    inner = F.filter(F.split(F.regexp_replace(F.regexp_extract("path", r"^(?:.*/)?app/(.*)$", 1), r"(?i)/?route\.\w+$", ""), "/"), lambda x: (x != "") & ~x.rlike(r"^\(.+\)$") & ~x.startswith("@"))
    part = lambda x: F.when(x.rlike(r"^\[\[?\.\.\..+\]\]?$"), "*").when(x.rlike(r"^\[.+\]$"), F.concat(F.lit(":"), F.regexp_extract(x, r"^\[(.*)\]$", 1))).otherwise(x)
    http = P.http_path(F.concat(F.lit("/"), F.array_join(F.transform(inner, part), "/")))
    none = F.array()
    df = df.withColumns({"method": F.upper("name"), "http": http, "framework": F.lit("next"), "request_fields": none.cast(_STRINGS), "response_fields": none.cast(_STRINGS), "statuses": none.cast(_INTS), "auth": F.lit("absent")})
    return _endpoints(df.withColumn("confidence", F.when(F.col("http").rlike("[:*]"), "pattern").otherwise("exact")), "server")


def controller_routes(rows: DataFrame) -> DataFrame:
    """Routes of decorated controller classes: the class's prefix, then the method's."""
    guarded = F.exists(F.map_keys("decorators"), lambda d: F.lower(d).isin(*AUTH_DECORATORS))
    plain = F.struct(F.lit("/").alias("path"), F.lit("exact").alias("confidence"))
    at = lambda text: F.coalesce(url_of(text), plain)
    classes = rows.filter("fact = 'class'").filter(F.array_contains(F.map_keys("decorators"), "Controller"))
    classes = classes.select(*KEY, F.col("first").alias("_from"), F.col("last").alias("_to"), at(F.col("decorators")["Controller"]).alias("_prefix"), guarded.alias("_guarded"))
    verb = F.get(F.filter(F.map_keys("decorators"), lambda d: F.lower(d).isin(*VERBS, "all")), F.lit(0))
    m = rows.filter("fact = 'method'").withColumns({"verb": verb, "own": guarded}).filter("verb is not null and lower(verb) <> 'all'")
    m = m.join(classes, KEY).filter("pos > _from and last < _to").withColumn("_url", at(F.element_at("decorators", F.col("verb"))))
    every = lambda pattern, of=F.col("scope"): F.regexp_extract_all(of, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(1))
    bodies = F.filter(F.transform("args", lambda a: F.regexp_extract(a["text"], r"^@Body\(\s*\)\s*([\w$]+)", 1)), lambda n: n != "")
    read = F.flatten(F.transform(bodies, lambda n: every(F.concat(F.lit(r"\b"), n, F.lit(r"\s*\.\s*([\w$]+)")))))
    given = F.flatten(F.transform(every(r"\breturn\s*\{((?:[^{}]|\{[^{}]*\})*)\}"), lambda o: F.transform(F.split(F.regexp_replace(o, r"\{[^{}]*\}|\([^()]*\)|\[[^\[\]]*\]", ""), ","), lambda x: F.regexp_extract(x, r"^\s*['\"]?([A-Za-z_$][\w$]*)['\"]?\s*(?::|$)", 1))))
    code = F.element_at("decorators", "HttpCode")
    names = [F.regexp_extract(F.get("args", F.lit(n))["text"], r"([\w$]+)\s*\??\s*(?::|$)", 1).alias(f"_p{n}") for n in (0, 1)]
    m = m.select("*", *names).withColumn("handler", F.struct(F.lit("function").alias("kind"), F.col("scope").alias("text"), "first", "last"))
    forced = F.when(code.rlike(r"^[1-9]\d*$"), F.array(code.cast("int"))).otherwise(F.array().cast(_INTS))
    m = m.withColumns({"_read": read, "_given": F.filter(given, lambda x: x != ""), "_forced": forced})
    m = _handled(m, rows, ("_p0", "_p1"))
    statuses = F.array_sort(F.array_distinct(F.concat("_forced", F.when((F.size("_forced") > 0) & (F.col("statuses") == F.array(F.lit(200))), F.array().cast(_INTS)).otherwise(F.col("statuses")))))
    m = m.withColumns({"request_fields": _sorted(F.concat("request_fields", "_read")), "response_fields": _sorted(F.concat("response_fields", "_given")), "statuses": statuses})
    m = m.withColumn("statuses", F.when((F.size("statuses") == 0) & (F.size("response_fields") > 0), F.array(F.lit(200))).otherwise(F.col("statuses")))
    both = F.when((F.col("_prefix.confidence") == "pattern") | (F.col("_url.confidence") == "pattern"), "pattern").otherwise("exact")
    return _endpoints(m.withColumns({
        "method": F.upper("verb"), "http": P.join_http(F.col("_prefix.path"), F.col("_url.path")), "framework": F.lit("nest"), "confidence": both, "auth": F.when(F.col("_guarded") | F.col("own"), "required").otherwise("absent"),
    }), "server")


def routes(rows: DataFrame) -> DataFrame:
    """All routes; those of receivers at every prefix under which these are mounted. Of equal ids the
    last stays: a controller's before a file's, a file's before a receiver's."""
    placed = R.mounted(route_drafts(rows).withColumn("receiver", F.col("receiver_key")), R.mount_prefixes(mounts(rows)), "http")
    ranked = lambda df, n: df.withColumn("_rank", F.lit(n))
    every = ranked(_endpoints(placed, "server"), 0).unionByName(ranked(file_routes(rows), 1)).unionByName(ranked(controller_routes(rows), 2))
    rest = [c for c in ENDPOINT if c not in ("project_id", "id")]
    last = every.groupBy("project_id", "id").agg(F.max_by(F.struct(*rest), F.struct("_rank", *rest)).alias("_last"))
    return last.select("project_id", "id", "_last.*")


# --- what is not known -----------------------------------------------------------------------------------


def unknowns(rows: DataFrame) -> DataFrame:
    """(project_id, side, file, line, expression, reason)."""
    texts = rows.filter("fact = 'file'").select(*KEY, F.col("text").alias("_text"))
    asked = _requests(rows).filter("url is null or method is null")
    reason = F.when(F.col("url").isNotNull(), "method-unknown").when(F.col("framework") == "fetch", "dynamic-fetch-url").otherwise("dynamic-axios-url")
    asked = asked.select(*KEY, "pos", "last", "line", F.lit("client").alias("side"), reason.alias("reason"))
    lost = _mount_rows(rows).filter("child is null and told")
    lost = lost.select(*KEY, "pos", "last", "line", F.lit("server").alias("side"), F.when(F.col("name") == "use", "unresolved-mount").otherwise("unresolved-plugin").alias("reason"))
    open_ = _route_calls(rows).filter("url is null").select(*KEY, "pos", "last", "line", F.lit("server").alias("side"), F.lit("dynamic-route-path").alias("reason"))
    found = asked.unionByName(lost).unionByName(open_).join(texts, KEY)
    expression = P.short_text(F.substring(F.col("_text"), F.col("pos") + 1, F.col("last") - F.col("pos")))
    found = found.select("project_id", "side", F.col("path").alias("file"), "line", expression.alias("expression"), "reason")
    broken = rows.filter("parse_error").select("project_id", F.lit("server").alias("side"), F.col("path").alias("file"), F.lit(1).alias("line"), F.col("path").alias("expression"), F.lit("syntax-error").alias("reason"))
    return found.unionByName(broken)
