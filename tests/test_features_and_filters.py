import gzip

import pytest

from termlift.operators import features as X
from termlift.operators import filters
from termlift.sources import text_formats as S

GAF = [
    ("P12345", "", "GO:0008150", "IDA", "P"), ("P12345", "", "GO:0005515", "IEA", "F"), ("P23456", "", "GO:0008150", "IMP", "P"),
    ("P23456", "", "GO:0005737", "ISS", "C"), ("P34567", "NOT|involved_in", "GO:0008150", "IDA", "P"), ("P34567", "", "GO:0003674", "TAS", "F"),
]


@pytest.fixture(scope="module")
def gaf(tmp_path_factory):
    lines = ["!gaf-version: 2.2"]
    for e, q, t, code, a in GAF:
        lines.append("\t".join(["UniProtKB", e, "SYM", q, t, "PMID:1", code, "", a, "name", "", "protein", "taxon:9606", "20240101", "X"]))
    lines += ["too\tfew\tfields", "", "\t".join(["UniProtKB", "P1", "S", "", "XX:1", "R", "IDA", "", "P", "n", "", "protein", "taxon:1", "2024", "X"])]
    path = tmp_path_factory.mktemp("gaf") / "goa.gaf.gz"
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def mapped(rows):
    out = {}
    for r in rows.select("entity", "term").distinct().collect():
        out.setdefault(r.entity, set()).add(r.term)
    return out


def test_annotations(spark, gaf):
    assert {k: len(v) for k, v in mapped(S.read_annotations(spark, gaf)).items()} == {"P12345": 2, "P23456": 2, "P34567": 1}
    assert mapped(S.read_preset(spark, gaf, "experimental")) == {"P12345": {"GO:0008150"}, "P23456": {"GO:0008150"}}
    manual = mapped(S.read_preset(spark, gaf, "unheard of"))
    assert manual["P12345"] == {"GO:0008150"} and manual["P34567"] == {"GO:0003674"}
    assert mapped(S.read_annotations(spark, gaf, exclude_negated=False))["P34567"] == {"GO:0008150", "GO:0003674"}
    assert mapped(S.read_annotations(spark, gaf, aspects=("C",))) == {"P23456": {"GO:0005737"}}
    # an empty collection is no filter
    assert mapped(S.read_annotations(spark, gaf, evidence=(), aspects=())) == mapped(S.read_annotations(spark, gaf))


def test_counters(spark, gaf):
    got = {r.disposition: r.n for r in S.annotation_counters(spark, gaf, filters.EXPERIMENTAL).collect()}
    assert got == {"malformed": 2, "excluded_qualifier": 1, "filtered_evidence": 3, "accepted": 2, "parse_error": 1}


OCC = [("P00001", "IPR001234", 10, 110), ("P00001", "IPR005678", 150, 250), ("P00002", "IPR001234", 20, 120), ("P00002", "IPR009876", 200, 300), ("P00002", "IPR005678", 350, 450), ("P00003", "IPR001234", 5, 105), ("P00003", "IPR999999", 110, 115)]


@pytest.fixture(scope="module")
def ipr(tmp_path_factory):
    path = tmp_path_factory.mktemp("ipr") / "p2i.dat"
    lines = [f"{e}\t{f}\tname\tPF1\t{s}\t{t}" for e, f, s, t in OCC] + ["", "short\tline", "P9\tIPR1\tn\tPF\tx\t9"]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_occurrences(spark, ipr):
    rows = S.read_occurrences(spark, ipr)
    assert rows.select("entity").distinct().count() == 3 and rows.count() == 6
    assert {r.feature: r.n_occurrences for r in X.top_features(rows).collect()}["IPR001234"] == 3
    assert S.read_occurrences(spark, ipr, most=2).select("entity").distinct().count() == 2
    allowed = spark.createDataFrame([("P00001",), ("P00002",)], "entity string")
    assert S.read_occurrences(spark, ipr, allowed=allowed).select("entity").distinct().count() == 2
    assert S.read_occurrences(spark, ipr, prefixes=["P00003"]).count() == 1
    assert S.read_occurrences(spark, ipr, least=6).count() == 7


def test_max_entities_stops_at_the_first_line_of_the_next(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("a", 4)], "entity string, ordinal long")
    assert sorted(r.ordinal for r in filters.max_entities(rows, 2).collect()) == [1, 2]
    assert filters.max_entities(rows, 3).count() == 4


def test_architectures(spark):
    rows = spark.createDataFrame([("e", 30, 3, "Z"), ("e", 10, 1, "X"), ("e", 10, 2, "Y"), ("s", 1, 4, "X"), ("r", 1, 5, "A"), ("r", 2, 6, "B"), ("r", 3, 7, "A"), ("r", 4, 8, "C")], "entity string, start int, ordinal int, feature string")
    got = {r.entity: (r.singles, r.composites) for r in X.architectures(rows, ["start", "ordinal"]).collect()}
    assert got["e"] == (["X", "Y", "Z"], ["X,Y", "Y,Z", "X,Y,Z"])
    assert got["s"] == (["X"], [])
    assert got["r"][1] == ["A,B", "B,A", "A,C", "A,B,A", "B,A,C"]
    two = {r.entity: r.composites for r in X.architectures(rows, ["start", "ordinal"], 2).collect()}
    assert two["r"] == ["A,B", "B,A", "A,C"]
    assert all(not r.composites for r in X.architectures(rows, ["start", "ordinal"], 1).collect())


def test_metadata(spark):
    rows = spark.createDataFrame([("e", "A"), ("f", "A"), ("e", "A,B"), ("e", "A,B,C")], "entity string, feature string")
    got = {r.feature: (r.feature_type, list(r.constituents), r.n_obs) for r in X.metadata(rows).collect()}
    assert got == {"A": ("single", [], 2), "A,B": ("supra_pair", ["A", "B"], 1), "A,B,C": ("supra_triple", ["A", "B", "C"], 1)}


@pytest.mark.parametrize("ends,head", [("\n", "format-version: 1.2\n\n"), ("\r\n", "format-version: 1.2\n\n"), ("\r\n", ""), ("\n", "")])
def test_ontology_file(spark, tmp_path, ends, head):
    path = tmp_path / "o.obo"
    text = """[Term]
id: GO:1
name: root
namespace: p
def: "The root." [x]

[Term]
id: GO:2
name: mid
namespace: p
is_a: GO:1 ! root

[Term]
id: GO:3
name: leaf
namespace: p
is_a: GO:2 ! mid
relationship: part_of GO:1 ! root

[Term]
id: GO:4
name: gone
is_obsolete: true
is_a: GO:1

[Typedef]
id: part_of
"""
    path.write_bytes((head + text).replace("\n", ends).encode())
    terms, edges = S.read_ontology(spark, str(path))
    assert sorted(r.term for r in terms.collect()) == ["GO:1", "GO:2", "GO:3"]
    assert sorted((r.child, r.parent, r.relation) for r in edges.collect()) == [("GO:2", "GO:1", "is_a"), ("GO:3", "GO:1", "part_of"), ("GO:3", "GO:2", "is_a")]
    assert terms.where("term = 'GO:1'").first().definition == "The root."
    assert S.preflight(spark, str(path), "format-version:" if head else "[Term]")


def test_gold_file_last_name_wins(spark, tmp_path):
    path = tmp_path / "gold"
    path.write_text("!comment\nInterPro:IPR1 Kringle > GO:binding ; GO:0005488\nInterPro:IPR1 Kringle > GO:binding again ; GO:0005488\nbad line\nInterPro:IPR2 a > b > c ; GO:1\n")
    assert [(r.feature, r.term, r.term_name) for r in S.read_gold(spark, str(path)).collect()] == [("IPR1", "GO:0005488", "binding again")]


def test_extract_lines(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("A\tx\nB\ty\nA\nA\tz\n")
    ids = tmp_path / "ids.txt"
    ids.write_text(" A \n\n")
    S.extract_lines(spark, S.read_ids(spark, str(ids)), str(src), str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["A\tx", "A\tz"]
    S.write_ids(spark.createDataFrame([("b",), ("a",), ("b",)], "entity string"), str(tmp_path / "w"))
    assert [r.value for r in spark.read.text(str(tmp_path / "w")).collect()] == ["a", "b"]
    assert S.species_paths("d", "human")["annotations"] == "d/goa_human.gaf.gz"


def test_lines_are_left_out_before_they_are_split(spark, tmp_path):
    """The same rows as without, and a plan that searches the line below the split."""
    from termlift.sources import text_formats

    line = lambda *f: "\t".join(["db", *f, *["x"] * (14 - len(f))])
    lines = ["!comment", "  !also", line("E1", "s", "", "GO:1", "r", "EXP", "", "P"), line("E2", "s", "", "GO:1", "r", "IEA", "", "P"), line("E3", "s", "", "GO:1", "r", "EXP", "", "F"), line("EXP", "s", "", "GO:1", "P", "IEA", "", "F"), "short\tEXP\tP\t"]
    (tmp_path / "a.gaf").write_text("\n".join(lines))
    for evidence, aspects, want in ((["EXP"], ["P"], ["E1"]), (["EXP", "IEA"], None, ["E1", "E2", "E3", "EXP"]), (None, ["F"], ["E3", "EXP"]), ([], [], ["E1", "E2", "E3", "EXP"])):
        got = text_formats.read_annotations(spark, str(tmp_path), evidence, aspects)
        assert sorted(r.entity for r in got.collect()) == want
    plan = text_formats.read_annotations(spark, str(tmp_path), ["EXP"], ["P"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(value" in plan
