"""Documents read in parts against the whole document."""

import json
import random

import pytest

from specmill.sources import jsonsplit, readers


@pytest.fixture(params=[80, 300, 1 << 20])
def parts(spark, request):
    """Bytes of a part: less than a record, some records, more than the file."""
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in before.items():
        spark.conf.set(n, v)


def records(n: int, seed: int) -> list:
    rnd = random.Random(seed)
    odd = ['a "quoted" text', "back\\slash", "\\", '\\"', "}{][,", '"},{"', "漢字🙂 é", "", "line\nbreak\t", "x" * 400]
    out = [{"id": f"p-{i}", "model": rnd.choice(odd), "manufacturer": rnd.choice(odd), "series": f"{i}", "classification": rnd.choice([[], ["d8"], ["d8", "},"], "CE, ATEX"]),
            "images": [{"url": f"/{k}.jpg", "alt": rnd.choice(odd)} for k in range(rnd.randrange(3))], "oddKey": {"data": [1, {"x": [[]]}]}} for i in range(n)]
    return out


WRAPS = {
    "bare": lambda r: json.dumps(r), "data": lambda r: json.dumps({"version": "1", "stats": {"data": [1, 2, 3]}, "data": r, "tail": [1, [2]]}, indent=1),
    "products": lambda r: " \n" + json.dumps({"products": r, "scrapedAt": "now, [then] {later}"}, ensure_ascii=False) + "\n\n",
    "both": lambda r: json.dumps({"products": [{"id": "other"}], "list": [[1], [2]], "data": r}),
    "data is no array": lambda r: json.dumps({"data": {"data": [1]}, "products": r}),
}


@pytest.mark.parametrize("wrap", WRAPS)
def test_records_are_those_of_the_document(spark, tmp_path, wrap, parts):
    made = {f"c{k}.json": records(n, k) for k, n in enumerate((0, 1, 5 if parts == 80 else 37))}
    for name, r in made.items():
        (tmp_path / name).write_text(WRAPS[wrap](r), encoding="utf-8")
    got = jsonsplit.split_records(spark, f"{tmp_path}/*.json").collect()
    assert sorted((r["_file"], r["_pos"], json.dumps(json.loads(r["record"]))) for r in got) == sorted((f, i, json.dumps(x)) for f, r in made.items() for i, x in enumerate(r))
    if parts == 300 and wrap != "data is no array":
        key = lambda r: (r["_file"], r["_pos"])
        whole, split = (sorted(f(spark, f"{tmp_path}/*.json").collect(), key=key) for f in (readers.read_catalog, readers.read_catalog_split))
        assert whole == split


def test_a_document_is_read_by_many_tasks(spark, tmp_path, parts):
    (tmp_path / "c.json").write_text(json.dumps({"data": records(200, 1)}))
    seen = jsonsplit._fragments(spark, str(tmp_path)).select("at").distinct().count()
    assert seen <= 8 if parts == 1 << 20 else seen > 20


def test_values_that_are_no_objects(spark, tmp_path, parts):
    values = [1, "a,b", None, [1, [2, 3]], True, {"a": {}}, "]", -2.5e3, [], {}]
    (tmp_path / "c.json").write_text(json.dumps(values))
    got = sorted(jsonsplit.split_records(spark, str(tmp_path)).collect(), key=lambda r: r["_pos"])
    assert [json.loads(r["record"]) for r in got] == values


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": 2', '{"data": [{"a": 1}]', '{"data": [{"a": "x}]}', '[{"a": 1}]]'])
def test_cut_documents_raise(spark, tmp_path, text):
    (tmp_path / "c.json").write_text(text)
    with pytest.raises(ValueError, match="no readable JSON in"):
        jsonsplit.split_records(spark, str(tmp_path))


def test_documents_without_records(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"stats": {"data": [1]}, "rows": [1]}')
    with pytest.raises(ValueError, match="no record array in"):
        readers.read_catalog_split(spark, str(tmp_path))
    assert readers.read_catalog_split(spark, str(tmp_path), on_bad="empty").collect() == []
    with pytest.raises(ValueError):
        readers.read_catalog_split(spark, str(tmp_path), on_bad="skip")
