"""Documents larger than a task come and go in pieces."""

import json
import random

import pytest
from pyspark.sql import functions as F

from footgrid.functions import geometry as G
from footgrid.sources import documents as D, tasks as TK


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few hundred bytes."""
    names = {"spark.sql.files.maxPartitionBytes": "300", "spark.sql.files.openCostInBytes": "1"}
    old = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in old.items():
        spark.conf.set(n, v)


def task(i, label):
    result = {"original_width": 200, "value": {"points": [[0, 0], [50, 0], [50, 50]], "polygonlabels": [label]}}
    return {"id": i, "file_upload": f"u-{i}.TIF", "annotations": [{"result": [result, result]}]}


ODD = ['a}b', '{"', '\\', '\\"}', "]},{", 'x\\\\"', "é}]", ""]


def test_long_arrays_are_cut_exactly(spark, tmp_path, small_ranges):
    rng = random.Random(1)
    want, whole = {}, {}
    for name, n, kw in (("one.json", 60, {}), ("wide.json", 40, {"indent": 3}), ("plain.json", 3, {"ensure_ascii": False})):
        items = [task(i, "".join(rng.choices(ODD, k=3))) for i in range(n)]
        mixed = [x for i, t in enumerate(items) for x in ((t, "no}thing", None, [[{}]]) if i % 7 == 0 else (t,))]
        whole[name] = json.dumps(mixed, **kw)
        (tmp_path / name).write_text(whole[name])
        want[name] = {i["id"]: i["annotations"][0]["result"][0]["value"]["polygonlabels"][0] for i in items}
    parts = D.pieces(spark, str(tmp_path), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    assert parts.select("file", "block").distinct().count() > 20
    cut = D.segments(parts, 1, lambda s: s).collect()
    assert sorted(cut) == sorted(D.segments(parts, 1, lambda s: s, run=2).collect())
    for name, text in whole.items():
        mine = sorted((r for r in cut if r.doc == name), key=lambda r: r.seg)
        assert "".join(r.text for r in mine) == text and [r.last for r in mine] == [False] * (len(mine) - 1) + [True]
        assert len(mine) == len(want[name]) + 1 and max(len(r.text) for r in mine) < 2500
    rows = TK.read_tasks(spark, str(tmp_path)).collect()
    for name, ids in want.items():
        assert {r.id: r.annotations[0].result[0].value.polygonlabels[0] for r in rows if r.json_name == name and r.corrupt is None} == ids
    bad = sorted(r.corrupt for r in rows if r.corrupt is not None and r.json_name == "plain.json")
    assert bad == ["[[{}]]", "no}thing", "null"]


def test_what_is_no_array_is_read_by_lines(spark, tmp_path, small_ranges):
    good = json.dumps([task(1, "roof")])
    texts = {"object.json": json.dumps(task(1, "x")), "lines.json": good + "\n" + good + "\nno", "quotes.json": "[{'id': 1, 'file_upload': 'a}\"-b'}]",
             "cut.json": good[:-1], "cut2.json": good[:-9], "more.json": good + "}", "none.json": "[]", "two.json": good[:-1] + good[1:], "void.json": ""}
    for n, t in texts.items():
        (tmp_path / n).write_text(t)
    rows = TK.read_tasks(spark, str(tmp_path)).collect()
    got = {n: sorted((r.id or 0, r.corrupt or "") for r in rows if r.json_name == n) for n in texts}
    bad = {n: [(0, texts[n])] for n in ("object.json", "cut.json", "cut2.json", "more.json", "none.json", "two.json")}
    assert got == bad | {"lines.json": [(0, "no"), (1, ""), (1, "")], "quotes.json": [(1, "")], "void.json": []}


def squares(spark, names):
    rows = [(n, p, k, [(float(k), 1.0), (9.0, 1.0 + p), (9.0, 9.0), (float(k), 1.0)]) for n in names for p in range(20) for k in (0, 1)]
    return spark.createDataFrame(rows + rows[:3], f"image string, pid long, part int, ring {G.RING_TYPE}").repartition(7)


def test_predictions_come_in_pieces(spark, tmp_path, small_ranges):
    names = ["img 0.TIF", 'a}"b', "", None]
    pieces = TK.prediction_json(squares(spark, names), 100, "m")
    assert pieces.select(F.max(F.length("prediction"))).first()[0] < 400
    rows = pieces.collect()
    for n in names:
        text = "".join(r.prediction for r in sorted((r for r in rows if r.image == n), key=lambda r: r.place))
        doc = json.loads(text)
        assert doc["data"] == ({} if n is None else {"image": f"/data/upload/2/{n}"}) and len(doc["predictions"]) == 1
        got = [(i["value"]["points"][1][1], i["id"]) for i in doc["predictions"][0]["result"]]
        assert got == sorted(got) and len(got) == (43 if n == names[0] else 40) and {i for _, i in got} == {0, 1}
    path = str(tmp_path / "out")
    TK.write_predictions(pieces, path)
    back = TK.read_predictions(spark, path).groupBy("image").agg(F.count("result.value.points").alias("n")).collect()
    assert {r.image: r.n for r in back} == {n: 43 if n == names[0] else 40 for n in names}


def test_cut_predictions_are_an_error(spark, tmp_path):
    (tmp_path / "doc=of-a").mkdir()
    (tmp_path / "doc=of-a" / "x.txt").write_text('{"predictions":[{"result":[{"id":"1"}')
    with pytest.raises(Exception, match="MALFORMED"):
        TK.read_predictions(spark, str(tmp_path)).collect()


def test_no_documents(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert TK.read_tasks(spark, str(tmp_path / "in")).count() == 0
    assert TK.prediction_json(squares(spark, ["a"]).where("pid < 0")).count() == 0
