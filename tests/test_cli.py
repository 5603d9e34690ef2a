from lattix import cli
from lattix.graph import PropertyGraph

from helpers import entities, relations


def test_query_takes_all_matches_and_hops(spark, tmp_path, capsys):
    methods = [(f"m:{i:02}", "Method", f"aligner {i:02}") for i in range(25)]
    entity = entities(spark, *methods, ("op:x", "Operation", "mapping"), ("data:y", "Data", "reads"))
    rel = relations(spark, *((m[0], "PERFORMS", "op:x") for m in methods), ("op:x", "INPUT", "data:y"))
    PropertyGraph(spark, entity, rel).save(str(tmp_path / "g"))
    cli.main(["--graph", str(tmp_path / "g"), "query", "aligner"])
    said = capsys.readouterr().out
    assert all(f"Method: aligner {i:02}" in said for i in range(25)) and "Data: reads" not in said
    cli.main(["--graph", str(tmp_path / "g"), "query", "aligner", "--k-hops", "2"])
    assert "Data: reads" in capsys.readouterr().out
