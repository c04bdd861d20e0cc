"""Every public function of the library is reached by a registered query, but for those named here with the reason."""

import ast
import pathlib

import assayer

ROOT = pathlib.Path(assayer.__file__).parent
CORE = ("functions", "operators", "sources", "streaming")
#: What a caller of the library uses that no query over tables can show.
OTHERWISE = {
    "register": "extension point", "builder": "extension point", "Scorer": "protocol of model calls", "stage_range": "chooses stages on the driver", "markdown": "text for people", "read_xlsx": "reads workbooks, which the tables are not",
    "gather": "polls a stream until enough is done; the query uses keyed state", "done": "of gather", "windowed_counts": "extension", "recommended_k": "driver's form of escalation", "table_fingerprint": "its hash is Spark's own",
}


def functions():
    """name -> names that its body mentions, over all modules; methods count for their class."""
    out, roots = {}, set()
    for path in ROOT.rglob("*.py"):
        where = path.relative_to(ROOT).parts[0]
        if where not in (*CORE, "plans"):
            continue
        for node in ast.parse(path.read_text(encoding="utf-8")).body:
            names = {n.id for n in ast.walk(node) if isinstance(n, ast.Name)} | {n.attr for n in ast.walk(node) if isinstance(n, ast.Attribute)} | {a.name for n in ast.walk(node) if isinstance(n, ast.ImportFrom) for a in n.names}
            if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
                out.setdefault(node.name, [where, set()])[1].update(names - {node.name})
            if where == "plans":
                roots |= names
    return out, roots


def test_each_operator_is_reached():
    defined, todo = functions()
    seen = set()
    while todo:
        name = todo.pop()
        if name in defined and name not in seen:
            seen.add(name)
            todo |= defined[name][1]
    lost = {n for n, (where, _) in defined.items() if where in CORE and not n.startswith("_") and n not in seen}
    assert lost - OTHERWISE.keys() == set()
