"""Files, warnings, configuration, text, drawing, JSON and plug-ins: the fixtures FW, TX, OU of FIXTURES.md."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from snapdelta.functions import codec, text
from snapdelta.model import Snapshot
from snapdelta.plans import output, render
from snapdelta.plans.config import STYLE_NAMES, Config, Placement, light_scheme, overridden
from snapdelta.plans.diff import Diff, Model
from snapdelta.plans.plugins import Augmenter, ClassDecorator, DiagramDecorator, InsertionPoint, Plugins
from snapdelta.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


def parse(path, content):
    """A toy language: 'class Name [extends Other]' a line."""
    found = []
    for line in content.splitlines():
        word = line.split()
        if word[0] != "class":
            raise ValueError(line)
        refs = [{"kind": "extension", "target": word[3]}] if len(word) > 3 else []
        found.append({"unique_name": word[1], "component_type": "CLASS", "source_file": path, "code_hash": len(line), "refs": refs})
    return found


def snapshot_files(spark, **contents):
    return spark.createDataFrame([(f"/{k}.java", v) for k, v in contents.items()], files.FILE_SCHEMA)


def test_warnings(spark):
    rows = snapshot_files(spark, fileA="oops", fileB="class B")
    failed = files.failures(files.parsed(rows, parse), files.parsed(rows, parse))
    assert [r.path for r in failed.collect()] == ["/fileA.java"]
    assert files.warnings(failed, ["/fileB.java"]).isEmpty()


def test_operation(spark):
    old = snapshot_files(spark, a="class A", bad="?")
    new = snapshot_files(spark, a="class A\nclass B extends A", bad="?")
    got = json.loads(output.Operation(old, new, parse).result().first().json)
    assert got["compileWarnings"] == ["/bad.java"]
    drawn = got["diagrams"][0]
    assert set(drawn) == {"packages", "size", "components", "relations", "changeSet", "compressedSVG"}
    assert all(isinstance(drawn[k], t) for k, t in (("packages", list), ("relations", dict), ("changeSet", dict), ("size", int), ("compressedSVG", str), ("components", list)))
    assert drawn["relations"]["B"][0]["targetComponent"] == "A" and drawn["components"][0]["comment"] is None
    assert drawn["size"] == 2 and drawn["changeSet"]["addedComponents"] == ["B"]
    diagram = one(spark, codec.decompressed, drawn["compressedSVG"])
    assert diagram.startswith("@startuml\n") and '"B" --[#00cc00]--|>"A"' in diagram
    with pytest.raises(ValueError, match="gone.java"):
        output.Operation(old, new, parse, Config().with_files(["/gone.java"]))
    assert output.Operation(old, new, parse, Config().with_files(["/a.java"])).warnings.isEmpty()
    nothing = json.loads(output.Operation(old, old, parse).result().first().json)
    assert nothing["diagrams"] == []


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.java").write_text("class X\nclass Y")
    (tmp_path / "in" / "x.txt").write_text("no")
    rows = files.of_languages(files.read_folder(spark, str(tmp_path / "in")), ["java"]).collect()
    assert [(r.path.endswith("/in/x.java"), r.content) for r in rows] == [(True, "class X\nclass Y")]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("src/Z.java", "class Z")
    assert [tuple(r) for r in files.read_archive(spark, str(tmp_path / "a.zip")).collect()] == [("/src/Z.java", "class Z")]


def test_config():
    assert Config().with_files(["src.java", "lol.cakes"]).files_filter == {"src.java"}
    with pytest.raises(ValueError):
        Config(max_components=0)
    with pytest.raises(ValueError):
        Config(languages=frozenset({"cobol?"}))
    base = light_scheme()
    assert len(STYLE_NAMES) == 33
    changed = overridden(base, {"class_font_size": "20", "title_font_color": None})
    assert changed["class_font_size"] == "20" and {k for k in base if changed[k] != base[k]} == {"class_font_size"}
    assert overridden(base, None) == base
    with pytest.raises(ValueError):
        overridden(base, {"nonsense": "1"})


def test_text(spark):
    assert one(spark, lambda c: text.wrapped(c, 10), "a test string that can be broken up.").split("\n") == ["a test", "string", "that can", "be broken", "up."]
    assert one(spark, text.comment_marks_removed, "/** a * b */") == " a  b "
    assert one(spark, text.brackets, "f(x)") == "f[x]"
    assert one(spark, text.normalized, " a \n\t b ") == "a b"
    assert one(spark, text.bold_lines, "a\nb") == "**a**\n**b**"
    assert one(spark, text.shortened, "x" * 900) == "x" * 797 + "...\n" and one(spark, text.shortened, "") == ""
    doc = one(spark, text.documentation, "/**\n * Calls <b>f(x)</b> for {@link Y}.\n * <p>More &amp; more</p>\n */")
    assert doc == "**Calls f[x] for {@link Y}. More & more**"
    assert one(spark, lambda c: text.ids_removed(F.lit("<a>p.A</a>"), c), ["p."], "array<string>") == "<a>A</a>"
    assert one(spark, codec.invalid_drawing, "<svg>Syntax Error?</svg>") and not one(spark, codec.invalid_drawing, "<svg/>")


def c(name, kind="CLASS", parent=None, **more):
    return {"unique_name": name, "component_type": kind, "parent_name": parent, **more}


OLD = [c("A", children=["A.x"]), c("A.x", "FIELD", "A", code_fragment="int x", modifiers=["private"]), c("B")]
NEW = [c("A", children=["A.x", "A.m"], comment="Says <i>so</i>"), c("A.x", "FIELD", "A", code_fragment="int x", modifiers=["private"]), c("A.m", "METHOD", "A", code_fragment="m()", modifiers=["public", "static"]), c("B")]


class Top(ClassDecorator):
    def lines(self, style):
        return F.array(F.lit("top line"), F.lit(None), F.lit(""))


class Bottom(ClassDecorator):
    point = InsertionPoint.BOTTOM

    def lines(self, style):
        return F.array(F.lit("bottom line\n"))


class Note(DiagramDecorator):
    def lines(self, style):
        return ["title T", None]


class AddB(Augmenter):
    def augment(self, diff, names):
        return names.union(diff.new.components.where("unique_name = 'B'").select("unique_name"))

    def metadata(self, nodes):
        return F.create_map(F.lit("k"), F.lit("v"))


def model(spark, plugins=None, enable=True, old=OLD, new=NEW):
    return Model(Diff(Snapshot.rows(spark, old, depth=1), Snapshot.rows(spark, new, depth=1)), plugins=plugins, enable_augmenters=enable)


def drawn(spark, plugins=None):
    return render.document(model(spark, plugins), light_scheme()).first().diagram


def test_drawing(spark):
    plain = drawn(spark)
    assert plain == drawn(spark) == drawn(spark, Plugins(class_decorators=(ClassDecorator(),)))
    assert 'class A as "A" #back:f8f8f8;header:24292e  {\n **Says so**\n--\n -  int x\n --\n +  <back:#bef5cb>{static} m()</back>         \n}' in plain
    more = drawn(spark, Plugins(class_decorators=(Bottom(), Top()), diagram_decorators=(Note(),)))
    assert more.index("class A") < more.index("top line") < more.index("int x") < more.index("bottom line") and "title T\n" in more
    large = [c("L", children=[f"L.f{i}" for i in range(21)]), *(c(f"L.f{i}", "FIELD", "L", code_fragment=f"int f{i}", code_hash=int(i == 3)) for i in range(21))]
    before = [{**r, "code_hash": 0} for r in large]
    block = render.class_blocks(model(spark, old=before, new=large), light_scheme()).first().block
    assert "(...)" in block and block.count("int f") == 1


def test_augmenters(spark):
    plugins = Plugins(augmenters=(AddB(),))
    got = {r.unique_name: r.augmentations for r in model(spark, plugins).nodes.collect()}
    assert set(got) == {"A", "B"} and got["B"] == {"k": "v"}
    assert {r.unique_name for r in model(spark, plugins, enable=False).nodes.collect()} == {"A"}


def test_cap_and_placement(spark):
    new = [c(f"{p}.X{i}", package={"path": p, "name": p}) for p in "ab" for i in range(3)]
    m = model(spark, old=[], new=new)
    assert output.diagram_summary(m, Config(max_components=5)).first().drawn is False
    capped = json.loads(output.diagrams(m, Config(max_components=5)).first().json)
    assert capped["size"] == 6 and capped["compressedSVG"] is None and len(capped["components"]) == 6
    assert json.loads(output.diagrams(m, Config(metadata_only=True)).first().json)["compressedSVG"] is None
    assert output.diagram_summary(m, Config(placement=Placement.ONE_PER_GROUP)).count() == 2
    alone = {r.diagram: json.loads(r.json) for r in output.diagrams(m, Config(placement=Placement.ONE_PER_GROUP)).collect()}
    assert {k: (v["packages"], v["size"]) for k, v in alone.items()} == {p: ([p], 3) for p in "ab"}
    for k, v in alone.items():
        text = one(spark, codec.decompressed, v["compressedSVG"])
        assert [x["uniqueName"] for x in v["components"]] == [f"{k}.X{i}" for i in range(3)] and text.count("namespace ") == 1 and f"namespace {k} " in text


def test_same_inner_names_stay_apart(spark):
    new = [c("O1"), c("O1.I", component_name="I"), c("O2"), c("O2.I", component_name="I")]
    block = render.document(model(spark, old=[], new=new), light_scheme()).first().diagram
    assert 'class O1-I as "I"' in block and 'class O2-I as "I"' in block
