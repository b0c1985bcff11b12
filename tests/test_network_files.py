"""Networks as files: parts stay small however many rows a task writes."""

from pathlib import Path

from tripwise.sources import graphml


def test_parts_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphml, "PART_ROWS", 10)
    nodes = spark.range(35).selectExpr("id AS node_id", "1.5D AS lat", "id / 10 AS lon", "true AS is_base").coalesce(1)
    edges = spark.range(45).selectExpr("id AS u", "id + 1 AS v", "0 AS k", "id * 2.0D AS length_m").coalesce(1)
    graphml.write_network(nodes, edges, str(tmp_path / "net"))
    assert len(list(Path(tmp_path / "net" / "nodes").glob("part-*"))) == 4
    assert len(list(Path(tmp_path / "net" / "edges").glob("part-*"))) == 5
    back_nodes, back = graphml.read_network(spark, str(tmp_path / "net"))
    assert sorted(r.node_id for r in back_nodes.collect()) == list(range(35))
    assert sorted((r.u, r.v, r.length_m) for r in back.collect()) == [(i, i + 1, i * 2.0) for i in range(45)]
