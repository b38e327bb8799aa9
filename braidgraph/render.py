"""Answers as Markdown for reading and as text for terminals."""

from __future__ import annotations

import json


def duration(ms: float) -> str:
    return f"{ms / 1000:.1f}s" if ms >= 1000 else f"{ms:g}ms"


def size(n: int) -> str:
    return f"{n / 2**20:.2f}MB" if n >= 2**20 else f"{n / 1024:.2f}KB" if n >= 1024 else f"{n}B"


def _tested(r: dict) -> list[str]:
    return [f"- Test: {r['testFile'] or 'none'}", f"- Complexity: {r['complexity']['level']} ({r['complexity']['value']})"]


def _flag(r: dict) -> str:
    return f"- Deprecated: {'yes (WARNING)' if r['metadata']['deprecated'] else 'no'}"


def _importers(r: dict) -> list[str]:
    files = [i["file"] for i in r["importedBy"]]
    return [f"### Imported by ({len(files)})", "- " + (", ".join(files) or "none (isolated)"), ""]


def scope_markdown(r: dict) -> str:
    module = r.get("module")
    if module:
        meta = module["metadata"] or {}
        files = [i["file"] for i in r["importedBy"]]
        doc = meta["jsDoc"][:100] + "..." if meta.get("jsDoc") else "none"
        lines = [f"## Scope: {module['name']} ({r['path']})", "### Kind", f"- {meta.get('kind') or 'unknown'} (exported)", "### JSDoc (truncated)", f"- {doc}", f"### Imported by ({len(files)})"]
        return "\n".join([*lines, *([f"- {f}" for f in files] or ["- none"]), "### Metadata", *_tested(r), _flag(r)]) + "\n"
    if r["type"] == "EXTERNAL":
        note = ["", "### Note", "- External package from node_modules", "- No exports/imports data available"]
        return "\n".join([f"## Scope: {r['name']}", "", *_importers(r), "### Metadata", *_tested(r), _flag(r), *note]) + "\n"
    by: dict[str, list[str]] = {}
    for e in r["exports"]:
        by.setdefault(e["kind"], []).append(e["name"])
    lines = [f"## Scope: {r['path']}", "", f"### Exports ({len(r['exports'])})", *([f"- {k}:{', '.join(n)}" for k, n in by.items()] or ["- none"]), ""]
    brought = [f"- '{i['from']}'{' [type-only]' if i['kind'] == 'type-only' else ''}" for i in r["imports"]]
    lines += [f"### Imports ({len(brought)})", *(brought or ["- none (leaf file)"]), "", *_importers(r), "### Metadata", *_tested(r)]
    if r["lastModified"].get("relativeTime"):
        lines.append(f"- Modified: {r['lastModified']['relativeTime']}")
    return "\n".join([*lines, _flag(r)]) + "\n"


def brief_markdown(r: dict) -> str:
    yes = lambda x, word: word if x else "no"
    return "\n".join([f"## Brief: {r['file']}", f"- Imports: {r['imports']}", f"- Imported by: {r['importedBy']}", f"- Test: {yes(r['hasTest'], 'yes')}", f"- Deprecated: {yes(r['deprecated'], 'yes (WARNING)')}", f"- Complexity: {r['complexityLevel']}"])


def impact_markdown(r: dict) -> str:
    s, files = r["summary"], r["affectedFiles"]
    lines = ["## Impact Analysis", "", "### Target Files", *[f"- {t.replace('FILE:', '', 1).replace('MODULE:', '', 1)}" for t in r["targets"]], ""]
    if s["direct"]:
        lines += [f"### Direct Dependents ({s['direct']} files)", *[f"- {f['path']}" for f in files if f["distance"] == 1], ""]
    else:
        lines += ["### Direct Dependents", "No direct dependents found.", ""]
    if s["indirect"]:
        lines += [f"### Indirect Dependents ({s['indirect']} files)", *[f"- {f['path']}" + (f" (via {', '.join(f['via'])})" if f["via"] else "") for f in files if f["distance"] > 1], ""]
    lines += ["### Summary", f"- Total affected: {s['total']} files", f"- Direct: {s['direct']}, Indirect: {s['indirect']}", ""]
    if r["truncated"]:
        lines += [f"> Showing {len(files)} of {s['total']} affected files (use `maxFiles: {s['total']}` to see all)", ""]
    return "\n".join(lines)


def layers_markdown(r: dict) -> str:
    lines = ["## Architecture Layers", ""]
    for layer in r["layers"]:
        lines += [f"### Layer {layer['layer']} ({layer['role']})", *[f"- **{g['name']}**: {g['fileCount']} files, imported by {g['importedByCount']} groups" for g in layer["groups"]], ""]
    v = r["violations"]
    if v:
        lines.append(f"## Layer Violations ({len(v)} detected)")
        for x in v:
            lines += [f"- **{x['fromGroup']} → {x['toGroup']}**: {x['count']} imports ({x['severity']})", f"  - Suggestion: {x['suggestion']}"]
    else:
        lines += ["## Layer Violations", "✓ All imports follow layer hierarchy"]
    lines += ["", f"## Layer Health Score: {r['healthScore']}/100"]
    if v:
        lines.append(f"- Violation penalty: -{100 - r['healthScore']} points ({len(v)} violations)")
    return "\n".join(lines)


def _next(r: dict) -> list[str]:
    return ["", "Next suggested:", *[f"- {s}" for s in r["nextSuggested"]]] if r.get("nextSuggested") else []


def scope_text(r: dict, ms: float) -> str:
    def part(title: str, items: list[str]) -> list[str]:
        return ["", f"{title}:", *items] if items else ["", f"{title}: none"]

    lines = ["Scope result", "", f"Target: {r['target']}", *part("Exports", [f"- {e['kind']}: {e['name']}" for e in r["exports"]]), *part("Imports", [f"- {i['from']}" for i in r["imports"]]), *part("Imported by", [f"- {i['file']}" for i in r["importedBy"]])]
    lines += ["", f"Test file: {r['testFile'] or 'No test file'}", "", f"Complexity: {r['complexity']['level']} ({r['complexity']['value']})"]
    m = r["lastModified"]
    lines += [f"Last modified: {m['relativeTime']}"] if m.get("relativeTime") else [f"Last modified: commit {m['commit']}"] if m.get("commit") else []
    lower = lambda x: str(x).lower()
    return "\n".join([*lines, "", f"Has test: {lower(r['metadata']['hasTest'])}", f"Deprecated: {lower(r['metadata']['deprecated'])}", "", f"Duration: {duration(ms)}", *_next(r)])


def impact_text(r: dict, ms: float) -> str:
    s, files = r["summary"], r["affectedFiles"]
    lines = ["Impact analysis complete", "", f"Total affected: {s['total']}", f"Direct: {s['direct']}", f"Indirect: {s['indirect']}", f"Blast radius: {r['blastRadius']}", ""]
    if files:
        lines.append(f"Affected files (showing {len(files)} of {s['total']}):" if r["truncated"] else "Affected files:")
        lines += [f"- {f['path']} ({'direct' if f['distance'] == 1 else 'indirect'})" + (f" via {' → '.join(f['via'])}" if f["via"] else "") for f in files]
        lines += ["", "Results truncated. Use --max-files to see more."] if r["truncated"] else []
    else:
        lines.append("No affected files found.")
    return "\n".join([*lines, f"Duration: {duration(ms)}", *_next(r)])


def layers_text(r: dict, ms: float, verbose: bool = False) -> str:
    lines = ["Architecture Layers", ""]
    for layer in r["layers"]:
        lines.append(f"Layer {layer['layer']}: {layer['role']}")
        if verbose and (info := layer.get("namingInfo")):
            lines.append(f"  [Pattern: {info['pattern']} ({'exact' if info['isExactMatch'] else 'partial'}, priority: {info['finalPriority']})]")
        lines += [*[f"  - {g['name']} ({g['fileCount']} files)" for g in layer["groups"]], ""]
    lines += [] if r["layers"] else ["No layers detected", ""]
    for i, v in enumerate(r["violations"]):
        lines += ["Violations:"] * (i == 0) + [f"  - {v['fromGroup']} → {v['toGroup']} ({v['severity']})", f"    Count: {v['count']}, Gap: {v['layerGap']}", f"    Suggestion: {v['suggestion']}"]
    lines += [] if r["violations"] else ["Violations: none"]
    lines += ["", f"Health Score: {r['healthScore']}/100", ""]
    lines += ["Groups:", *[f"  - {g['name']}: Layer {g['assignedLayer']}, Net Score: {g['netScore']}" for g in r["groups"]], ""] if r["groups"] else []
    return "\n".join([*lines, f"Duration: {duration(ms)}", *_next(r)])


def error_text(e: dict, ms: float) -> str:
    err = e["error"]
    return "\n".join([f"Error: {err['message']}", f"Code: {err['code']}", *([f"Suggestion: {err['suggestion']}"] if err.get("suggestion") else []), f"Duration: {duration(ms)}"])


def as_json(r: dict) -> str:
    return json.dumps(r, ensure_ascii=False, default=lambda x: x.asDict(True) if hasattr(x, "asDict") else str(x))
