"""Source trees, what is extracted from them, and records, on a small project."""

import json

import pytest

from strata.operators import extract
from strata.sources import records, tree

FILES = {
    "src/shop/__init__.py": "",
    "src/shop/models.py": "import os\n\nclass Item:\n    def price(self):\n        pass\n",
    "src/shop/service.py": "from .models import Item\nimport shop.models\nasync def sell():\n    pass\n",
    "src/shop/sub/deep.py": "from ..models import Item\nfrom . import other\n",
    "web/api.ts": "import {a} from './util'\nimport r from \"react\"\nexport async function load() {}\nexport class Api {}\n",
    "web/util.ts": "const x = require('../web/api')\n",
    "tests/test_shop.py": "from shop.service import sell\n",
    "cmd/main.go": "// Code generated by x. DO NOT EDIT.\nfunc (s *S) Run() {}\ntype S struct {\n",
    "node_modules/x/index.js": "function no() {}\n",
    ".git/a.py": "class No: pass\n",
    "notes.txt": "class No: pass\n",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bin.py").write_bytes(b"\0\1")
    (root / "latin.py").write_bytes(b"# \xe9\n")
    (root / "loop").symlink_to(root)
    return tree.read_tree(spark, str(root), ignore=("skip/*",)).cache()


def test_tree(files):
    got = {r.file_path: r.content for r in files.collect()}
    assert set(got) == {p for p in FILES if not p.startswith(("node_modules", ".git", "notes"))} | {"latin.py"}
    assert got["latin.py"] == "# é\n"


def test_nodes(files):
    m = {r.file_path: r for r in extract.modules(files).collect()}
    assert m["src/shop/__init__.py"].qualified_name == "shop" and m["src/shop/models.py"].line_end == 6
    assert [m[p].is_test for p in ("tests/test_shop.py", "web/api.ts")] == [True, False]
    assert m["cmd/main.go"].is_generated and m["cmd/main.go"].is_entry_point
    got = {(r.qualified_name, r.kind, r.line_start, r.is_async) for r in extract.declarations(files).collect()}
    assert got == {
        ("shop.models.Item", "class", 3, False), ("shop.models.price", "function", 4, False), ("shop.service.sell", "function", 3, True), ("web.api.load", "function", 3, True),
        ("web.api.Api", "class", 4, False), ("cmd.main.Run", "function", 2, False), ("cmd.main.S", "class", 3, False),
    }


def test_edges(files):
    got = {(r.file_path, r.target_path) for r in extract.edges(files).collect() if r.is_resolved}
    assert got == {
        ("src/shop/service.py", "src/shop/models.py"), ("src/shop/sub/deep.py", "src/shop/models.py"), ("web/api.ts", "web/util.ts"), ("web/util.ts", "web/api.ts"), ("tests/test_shop.py", "src/shop/service.py"),
    }
    assert extract.edges(files.limit(0)).count() == 0


def test_records_round_trip(spark, tmp_path):
    (tmp_path / "a.yaml").write_text("id: DEC-001\ntitle: One\nstatus: active\ntags: [x, y]\ncode_anchors: ['src/a.py:3-9', 'src/b.py', 'c:d']\nconstraints: [fast]\n")
    (tmp_path / "b.yaml").write_text("")
    (tmp_path / "c.yaml").write_text("- no\n- mapping\n")
    (tmp_path / "d.yaml").write_text("id: [\n")
    got = records.read_decisions(spark, str(tmp_path))
    r = got.first()
    assert got.count() == 1 and [tuple(a)[:3] for a in r.code_anchors] == [("src/a.py", 3, 9), ("src/b.py", None, None), ("c:d", None, None)]
    assert r.constraints[0].description == "fast" and r.constraints[0].source == "unknown"
    records.write_records(got.drop("file_path"), str(tmp_path / "out"))
    back = records.read_decisions(spark, str(tmp_path / "out")).drop("file_path").first()
    assert json.dumps(back.asDict(True), default=str) == json.dumps(r.asDict(True) | {}, default=str).replace('"file_path": "a.yaml", ', "")
