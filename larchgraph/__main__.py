"""Gates from a command line; exit code 0 passed, 1 failed, 2 wrong use or unreadable input.

python -m larchgraph [PATH] [--json] [--allow-unknown]
python -m larchgraph --before A --after B [--policy FILE] [--json] [--allow-unknown]
"""

from __future__ import annotations

import argparse
import json
import sys

#: Rows of each part of a printed report.
SHOWN = 1000


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="larchgraph", allow_abbrev=False)
    p.add_argument("path", nargs="?")
    p.add_argument("--path", dest="at")
    p.add_argument("--before")
    p.add_argument("--after")
    p.add_argument("--policy")
    p.add_argument("--json", action="store_true")
    p.add_argument("--allow-unknown", action="store_true")
    return p


def arguments(args: list[str]) -> argparse.Namespace:
    p = parser()
    a = p.parse_args(args)
    if a.path and a.at:
        p.error("one PATH only")
    a.path = a.path or a.at
    if bool(a.before) != bool(a.after):
        p.error("--before and --after go together")
    if a.policy and not a.before:
        p.error("--policy needs --before and --after")
    if a.path and a.before:
        p.error("PATH excludes --before and --after")
    return a


def _policy(file: str | None):
    from larchgraph.operators.policy import Policy

    if not file:
        return Policy()
    with open(file, encoding="utf-8") as f:
        return Policy.from_json(json.load(f))


def _rows(df) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(SHOWN).collect()]


def report(a: argparse.Namespace, spark) -> tuple[dict, list[str]]:
    """(the gate with its report, lines to read)."""
    from larchgraph import api
    from larchgraph.sources import corpus

    if a.before:
        policy = _policy(a.policy)
        files = corpus.read_tree(spark, a.before, "before").unionByName(corpus.read_tree(spark, a.after, "after"))
        checks, overall, gate, print_ = api.verify_change(files, policy, a.allow_unknown)
        out = gate.first().asDict() | {"report": overall.first().asDict() | print_.first().asDict() | {"checks": _rows(checks)}}
        lines = [f"change: {out['report']['status']}", f"{out['errors']} failed checks, {out['unknowns']} unknown checks", f"fingerprint: {out['report']['fingerprint']}"]
        return out, lines + [f"- {c['id']}: {c['status']}, {c['n']} found" for c in out["report"]["checks"] if c["status"] != "pass"]
    radar = api.contract_radar(corpus.source_files(spark, path=a.path or "."), a.allow_unknown)
    parts = {n: _rows(getattr(radar, n)) for n in ("clients", "routes", "observations", "matches", "issues", "unknowns")}
    counts = (_rows(radar.summary) or [{}])[0]
    out = radar.gate.first().asDict() | {"report": {"summary": counts} | parts}
    lines = [f"radar: {'passed' if out['passed'] else 'failed'}", f"{counts.get('client_calls', 0)} client calls, {counts.get('server_routes', 0)} routes, {counts.get('matches', 0)} matches", f"{out['errors']} errors, {out['unknowns']} unknown"]
    lines += [f"- {i['kind']}: {i['id']}" for i in parts["issues"] if i["severity"] == "error"]
    return out, lines + [f"- unknown: {u['reason']} in {u['file']}, line {u['line']}" for u in parts["unknowns"][:1]]


def main(args: list[str]) -> int:
    a = arguments(args)
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("larchgraph").getOrCreate()
    try:
        out, lines = report(a, spark)
    except (OSError, ValueError, AnalysisException) as e:
        print(f"larchgraph: {e}", file=sys.stderr)
        return 2
    print(json.dumps(out, indent=2, ensure_ascii=False) if a.json else "\n".join(lines))
    return int(out["exit_code"])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
