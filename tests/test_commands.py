"""Scans of small repositories, end to end."""

import pytest
from pyspark.sql import functions as F

from lattica.index import Index
from lattica.plans import commands
from lattica.sources.scan import read_files

FILES = {
    "src/orders/service.ts": """import { charge } from '../billing/charge';
export class OrderService {
  /** cancels */
  cancel(id: string): Receipt { return this.refund(id); }
  refund(id: string) { return charge(id); }
}
export interface Receipt { id: string }
// function ghost() { charge('x') }
const note = "charge(1)";
""",
    "src/billing/charge.ts": "export function charge(id: string) { return log(id); }\nfunction log(id: string) { return id; }\n",
    "src/api/routes.ts": "import express from 'express';\nconst app = express();\nfunction getOrder(req, res) { res.send(1); }\napp.get('/api/orders/:id', getOrder);\n",
    "web/client.ts": "export async function load(id: string) { return fetch(`/api/orders/${id}`); }\n",
    "tools/report.py": "from tools.util import total\n\n\nclass Report:\n    def run(self):\n        return self.lines()\n\n    def lines(self):\n        return total([1])\n",
    "tools/util.py": "def total(xs):\n    return sum(xs)\n",
    "tools/test_util.py": "from tools.util import total\n\n\ndef test_total():\n    assert total([1]) == 1\n",
    "node_modules/x/index.js": "module.exports = 1;\n",
    ".env": "SECRET=1\n",
}


def put(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    put(root, FILES)
    index, n = commands.scan(Index(spark), read_files(spark, str(root)))
    saved = tmp_path_factory.mktemp("index")
    index.save(str(saved))
    return root, Index.load(spark, str(saved)), {r.status: r.n for r in n.collect()}


def named_edges(index):
    s = index.symbols.select("id", "name")
    rows = index.relationships.join(s.select(F.col("id").alias("source_id"), F.col("name").alias("a")), "source_id").join(s.select(F.col("id").alias("target_id"), F.col("name").alias("b")), "target_id")
    return {(r.a, r.relationship_type, r.b): r for r in rows.collect()}


def test_first_scan(scanned):
    _, index, n = scanned
    assert n == {"inserted": 7}
    paths = {r.path for r in index.files.collect()}
    assert paths == set(FILES) - {"node_modules/x/index.js", ".env"}
    names = {(r.name, r.type) for r in index.symbols.collect()}
    assert {("OrderService", "class"), ("cancel", "method"), ("charge", "function"), ("Receipt", "interface"), ("Report", "class"), ("total", "function"), ("GET /api/orders/:id", "route")} <= names
    assert not any(a == "ghost" for a, _ in names)


def test_edges(scanned):
    _, index, _ = scanned
    e = named_edges(index)
    for edge in [
        ("cancel", "CALLS", "refund"), ("refund", "CALLS", "charge"), ("charge", "CALLS", "log"), ("run", "CALLS", "lines"), ("lines", "CALLS", "total"),
        ("src/orders/service.ts", "IMPORTS", "src/billing/charge.ts"), ("tools/report.py", "IMPORTS", "tools/util.py"), ("src/orders/service.ts", "CONTAINS", "OrderService"),
        ("getOrder", "ROUTES_TO", "GET /api/orders/:id"), ("src/api/routes.ts", "CONTAINS", "GET /api/orders/:id"), ("load", "CALLS_API", "GET /api/orders/:id"), ("tools/test_util.py", "TESTS", "tools/util.py"),
    ]:
        assert edge in e, edge
    assert e["refund", "CALLS", "charge"].evidence == "EXTRACTED" and e["load", "CALLS_API", "GET /api/orders/:id"].confidence == 0.7


def test_scan_again_changes_nothing(spark, scanned):
    root, index, _ = scanned
    again, n = commands.scan(index, read_files(spark, str(root)))
    assert {r.status: r.n for r in n.collect()} == {"unchanged": 7}
    for table in ("files", "symbols", "relationships"):
        assert sorted(map(str, getattr(again, table).collect())) == sorted(map(str, getattr(index, table).collect()))


def test_edit_and_delete(spark, scanned, tmp_path):
    root, index, _ = scanned
    put(tmp_path, {k: v for k, v in FILES.items() if k != "tools/report.py"} | {"src/billing/charge.ts": "// moved\n" + FILES["src/billing/charge.ts"] + "export function extra() {}\n"})
    after, n = commands.scan(index, read_files(spark, str(tmp_path)))
    assert {r.status: r.n for r in n.collect()} == {"unchanged": 5, "updated": 1, "removed": 1}
    ids = lambda i: {(r.name, r.type): r.id for r in i.symbols.collect()}
    old, new = ids(index), ids(after)
    assert all(new[k] == old[k] for k in new if k in old) and ("extra", "function") in new and ("Report", "class") not in new
    assert new["extra", "function"] not in old.values()
    assert ("refund", "CALLS", "charge") in named_edges(after)
    pairs = after.relationships.groupBy("source_id", "target_id", "relationship_type").count()
    assert pairs.where("count > 1").isEmpty()
    assert {r.name: r.n for r in commands.status(after).collect()}["orphans"] == 0


def test_context_impact_path(scanned):
    _, index, _ = scanned
    c = commands.context(index, "cancel order refund")
    first = c.ranked.orderBy(F.desc("score"), "id").first()
    assert first.path == "src/orders/service.ts"
    assert "src/orders/service.ts" in {r.path for r in c.high.collect()}
    assert c.shape.first().complexity in ("SIMPLE", "COMPLEX")
    risk = commands.impact_of(index, "charge").collect()
    assert len(risk) >= 1 and all(r.level in ("LOW", "MEDIUM", "HIGH") for r in risk)
    hops = commands.path_between(index, "cancel", "log")
    assert hops is not None and len(hops) == 3
    assert commands.path_between(index, "log", "no such thing at all") is None


def test_analysed(scanned):
    _, index, _ = scanned
    full = commands.analysed(index)
    nodes = index.symbols.count()
    assert full.node_metrics.count() == nodes and full.clusters.count() == nodes
    assert abs(full.node_metrics.agg(F.sum("pagerank")).first()[0] - 1) < 1e-6


def test_queries_of_models(spark, tmp_path):
    put(
        tmp_path,
        {
            "db/schema.ts": "import { pgTable, text } from 'drizzle-orm/pg-core';\nexport const invoices = pgTable('invoices', { id: text('id') });\n",
            "src/list.ts": "import { invoices } from '../db/schema';\nexport function list(db) {\n  return db.select().from(invoices);\n}\n",
            "src/top.ts": "db.select().from(Invoices);\n",
        },
    )
    index, _ = commands.scan(Index(spark), read_files(spark, str(tmp_path)))
    models = index.symbols.where("type = 'model'").select(F.col("id").alias("target_id"), F.col("name").alias("model"))
    rows = index.relationships.where("relationship_type = 'QUERIES'").join(models, "target_id").join(index.symbols.select(F.col("id").alias("source_id"), "name", "type"), "source_id").collect()
    assert {(r.model, r.type) for r in rows} == {("invoices", "function"), ("invoices", "file")}
    assert all((r.weight, r.confidence, r.evidence) == (0.8, 0.9, "INFERRED") for r in rows) and len(rows) == 2
