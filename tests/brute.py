"""Plain, row-at-a-time statements of problems 1 to 6, written against their definitions and not against the operators."""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pandas as pd


def _rows(pdf: pd.DataFrame) -> list[dict]:
    seen, out = set(), []
    for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
        k = tuple(str(v) for v in r.values())
        if k not in seen:
            seen.add(k)
            out.append(r)
    return out


def p1(frontmatter, files):
    ctime = {r["path"]: r["ctime"] for r in _rows(files)}
    where = {p: (p.split("/")[0], datetime.fromtimestamp(c, timezone.utc).strftime("%Y-%m")) for p, c in ctime.items() if "/" in p}
    n = Counter(where.values())
    rows = [(*where[r["path"]], r["path"], r["key"], r["type"], r["value_json"]) for r in _rows(frontmatter) if r["path"] in where]
    by = defaultdict(list)
    for f, m, p, k, t, v in rows:
        by[f, m, k].append((p, t, v))
    schema = defaultdict(dict)
    for (f, m, k), x in by.items():
        if 2 * len({p for p, _, _ in x}) >= n[f, m]:
            c = Counter(t for _, t, _ in x)
            schema[f, m][k] = min(c, key=lambda t: (-c[t], t))
    out = set()
    for f in {f for f, _ in n}:
        months = sorted(m for g, m in n if g == f)
        for a, b in zip(months, months[1:]):
            old, new = schema[f, a], schema[f, b]
            gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
            out |= {(f, b, "retyped", k, "") for k in old.keys() & new.keys() if old[k] != new[k]}
            for o in list(gone):
                for c in list(come):
                    fresh = {v for _, _, v in by[f, b, c]}
                    past = {v for m in months if m < b for _, _, v in by[f, m, o]}
                    if old[o] == new[c] and 2 * len(fresh & past) > len(fresh):
                        out.add((f, b, "renamed", c, o))
                        gone.remove(o)
                        come.remove(c)
                        break
            out |= {(f, b, "removed", k, "") for k in gone} | {(f, b, "added", k, "") for k in come}
    return out


def instant(s):
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)[ T](\d\d:\d\d:\d\d)(?:\.(\d+))?(Z|[+-]\d\d:\d\d)?", s)
    d = datetime.strptime(f"{m[1]} {m[2]}", "%Y-%m-%d %H:%M:%S") + timedelta(milliseconds=int(((m[3] or "") + "000")[:3]))
    if m[4] and m[4] != "Z":
        d -= timedelta(hours=int(m[4][:3]), minutes=int(m[4][0] + m[4][4:]))
    return d


def p2(history, tickets):
    born = {}
    for r in sorted(_rows(tickets), key=lambda r: r["updated_at"]):
        born[r["record_id"].strip().upper()] = instant(r["created_at"])
    at = defaultdict(lambda: defaultdict(set))
    for r in _rows(history):
        if r["deleted_at"] is None:
            at[r["ticket_record_id"].strip().upper(), r["field"]][instant(r["changed_at"])].add((r["old_value"], r["new_value"]))
    text = lambda d: d.strftime("%Y-%m-%d %H:%M:%S.") + f"{d.microsecond // 1000:03d}"
    out = set()

    def ends(edges):
        real = {e for e in edges if e[0] != e[1]} or edges
        if len(real) == 1:
            return next(iter(real))
        first = [o for o, _ in real if sum(x == o for x, _ in real) > sum(y == o for _, y in real)]
        last = [n for _, n in real if sum(y == n for _, y in real) > sum(x == n for x, _ in real)]
        return (first[0], last[0]) if last else None

    for (t, f), days in at.items():
        order = sorted(days)
        got = [ends(days[d]) for d in order]
        for i, g in enumerate(got):
            if g is None:
                values = {v for e in days[order[i]] for v in e}
                prior = [x for x in got[:i]]
                later = [x for x in got[i + 1 :] if x]
                if prior and prior[-1][1] in values:
                    v = prior[-1][1]
                elif later and later[0][0] in values:
                    v = later[0][0]
                else:
                    v = min(values, key=lambda x: (x is not None, x))
                got[i] = (v, v)
        seq = ([(born[t], got[0][0])] if t in born and born[t] < order[0] else []) + [(d, g[1]) for d, g in zip(order, got)]
        runs = []
        for d, v in seq:
            if not runs or runs[-1][1] != v:
                runs.append((d, v))
        for i, (d, v) in enumerate(runs):
            if v is not None:
                out.add((t, f, text(d), text(runs[i + 1][0]) if i + 1 < len(runs) else "open"))
    return out


def latest(rows, key):
    out = {}
    for r in rows:
        if r[key] is not None:
            k = r[key].strip().upper()
            if k not in out or (r["updated_at"] or "") > (out[k]["updated_at"] or ""):
                out[k] = r
    return out


def p3(decision_refs, tickets, decisions, links, files):
    live = {k for k, r in latest(_rows(decisions), "id").items() if r["deleted_at"] is None}
    out = set()
    for r in _rows(decision_refs):
        if r["deleted_at"] is None and r["target_id"] is not None and r["target_id"].strip() and r["target_id"].strip().upper() not in live:
            out.add(("decision_refs", r["source_id"], r["target_id"]))
    for r in latest(_rows(tickets), "record_id").values():
        ref = r["decision_ref"]
        if r["deleted_at"] is None and ref is not None and ref.strip() and ref.strip().upper() not in live:
            out.add(("tickets", r["record_id"], ref))
    names = set()
    for r in _rows(files):
        for x in (r["path"], r["path"].split("/")[-1]):
            names |= {x, x[:-3] if x.endswith(".md") else x}
    for r in _rows(links):
        t = r["target_path"].split("#")[0].strip()
        if t and not t.lower().startswith(("http:", "https:", "mailto:")) and t not in names:
            out.add(("links", r["source_path"], r["target_path"]))
    return out


def p4(tickets, changelog):
    state = {("tickets", r["record_id"]): r for r in latest(_rows(tickets), "record_id").values()}
    for r in sorted(_rows(changelog), key=lambda r: (r["log_file"], r["line_no"])):
        body = json.loads(r["row_json"])
        k = (r["table_name"], "|".join(str(body[c]) for c in r["key_columns"].split(",")))
        if k not in state or r["updated_at"] >= state[k]["updated_at"]:
            state[k] = r
    return {(*k, r["hash"]) for k, r in state.items() if r["deleted_at"] is None}


def p5(tickets):
    live = {k: r for k, r in latest(_rows(tickets), "record_id").items() if r["deleted_at"] is None}
    up = {k: (r["parent_record_id"] or "").strip().upper() for k, r in live.items()}
    out = set()
    for k, r in live.items():
        depth, at, seen = 0, k, {k}
        while up[at] in live:
            at = up[at]
            depth += 1
            if at in seen:
                depth = -1
                break
            seen.add(at)
        out.add((r["record_id"], "cycle" if depth < 0 else live[at]["record_id"], depth))
    return out


def p6(frontmatter, wide_spec):
    spec = {r["key_name"]: r["col_type"] for r in _rows(wide_spec)}
    out = set()
    for r in _rows(frontmatter):
        k = re.sub(r"[-\s]", "_", r["key"].strip().lower())
        if k not in spec:
            continue
        v, kind, cell = json.loads(r["value_json"]), spec[k], None
        num = isinstance(v, (int, float)) and not isinstance(v, bool)
        if kind == "number" and (num or isinstance(v, str) and re.fullmatch(r"[+-]?\d+(\.\d+)?", v.strip())):
            cell = f"{float(v):.3f}"
        elif kind == "bool":
            if isinstance(v, bool) or num and v in (0, 1):
                cell = "true" if v else "false"
            elif isinstance(v, str):
                cell = {"true": "true", "yes": "true", "on": "true", "false": "false", "no": "false", "off": "false"}.get(v.strip().lower())
        elif kind == "date" and isinstance(v, str):
            for pat, fmt in ((r"(\d{4}-\d\d-\d\d)([T ].*)?", "%Y-%m-%d"), (r"(\d{4}/\d\d/\d\d)", "%Y/%m/%d"), (r"(\d\d\.\d\d\.\d{4})", "%d.%m.%Y")):
                if m := re.fullmatch(pat, v, re.S):
                    try:
                        cell = datetime.strptime(m[1], fmt).strftime("%Y-%m-%d")
                    except ValueError:
                        pass
        elif kind == "list" and isinstance(v, (list, str)):
            parts = re.split(r"[,;\s]+", v) if isinstance(v, str) else [x if isinstance(x, str) else json.dumps(x) for x in v if x is not None]
            cell = ",".join(p for p in (re.sub("^#", "", x.strip()).strip() for x in parts) if p)
        elif kind == "string" and isinstance(v, str):
            cell = v.strip()
        if cell:
            out.add((r["path"], k, cell))
    return out
