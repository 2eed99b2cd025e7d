import bz2
import gzip
import json
import os
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import evalgrid as eg
from evalgrid.sources import pieces, records
from tests.test_files import SLIM
from tests.test_splits import put


def lines(first, n):
    return "".join(json.dumps({"Key": first + i, "goldresp": "TRUE"}) + "\n" for i in range(n))


def archive(path, members, kind=zipfile.ZIP_DEFLATED, ahead=0):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.truncate(ahead)  # a hole in the file, no bytes on the disk
        f.seek(ahead)
        with zipfile.ZipFile(f, "w", kind) as z:
            for name, text in members:
                z.writestr(name, text)
    return path


def _keys(df):
    return sorted(r.Key for r in df.collect())


def test_an_archive_larger_than_a_cell(spark, folder):
    path = archive(f"{folder}/x.jsonl.zip", [("a.jsonl", lines(0, 5))], ahead=(1 << 31) + 5000)
    assert os.path.getsize(path) > 1 << 31
    assert _keys(eg.read_json(spark, path, SLIM)) == [0, 1, 2, 3, 4]


def test_members_are_spread_over_tasks(spark, folder):
    path = archive(f"{folder}/x.jsonl.zip", [(f"d/{i}.jsonl", lines(10 * i, 10)) for i in range(40)] + [("d/", "")])
    members = pieces.zip_members(pieces.files_of(spark, [path]))
    assert members.count() == 40
    assert eg.read_json(spark, path, SLIM).count() == 400
    held = [len(x) for x in pieces.member_texts(members).rdd.glom().collect()]
    assert sum(held) == 400 and max(held) < 400 and sum(n > 0 for n in held) > 1


@pytest.mark.parametrize("kind", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_rows_are_numbered_through_the_members(spark, folder, kind):
    blank = "\n  \r\n"
    path = archive(f"{folder}/a b%20+/trials.jsonl.zip", [("z", lines(0, 30) + blank), ("empty", ""), ("a", blank + lines(30, 30))], kind)
    other = archive(f"{folder}/two/trials.jsonl.zip", [("x", lines(100, 7))], kind)
    rows = eg.load_trials_as_dataframe(spark, [path, other], auto_deobfuscate=False).collect()
    assert {r.Key: (r.EXPNAME, r.EXP_i) for r in rows} == {i: ("a b%20+", i) for i in range(60)} | {100 + i: ("two", i) for i in range(7)}


def test_file_systems_that_only_spark_reads(spark, folder, monkeypatch):
    path = archive(f"{folder}/x.jsonl.zip", [("a", lines(0, 3)), ("b", lines(3, 3))])
    monkeypatch.setattr(pieces, "reaches", lambda path: False)
    assert _keys(eg.read_json(spark, path, SLIM)) == list(range(6))
    assert not pieces.reaches("viewfs://x/y")


def test_no_file_system_of_arrow():
    assert not pieces.reaches("viewfs://x/y") and pieces.reaches("file:/tmp/a b%") and pieces.reaches("/tmp/x")


# --- documents ---------------------------------------------------------------

_RECORD = st.dictionaries(st.text('a"\\[]{},: é\n', max_size=4), st.recursive(
    st.none() | st.integers() | st.text('b"\\[]{},: 🙂', max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=2), x, max_size=2), max_leaves=5
), max_size=3)


@settings(max_examples=300, deadline=None)
@given(st.lists(_RECORD, max_size=5), st.integers(1, 9), st.sampled_from([None, 2]), st.booleans())
def test_records_of_a_list_in_pieces(rows, size, indent, escaped):
    text = " \n" + json.dumps(rows, indent=indent, ensure_ascii=escaped) + "\n "
    splitter = pieces.RecordSplitter()
    found = [r for i in range(0, len(text), size) for r in splitter.feed(text[i:i + size])]
    assert [json.loads(r) for r in found] == rows
    assert splitter.ended and not splitter.odd
    cut = text.rstrip()[:-1]
    splitter = pieces.RecordSplitter()
    found = [r for i in range(0, len(cut), size) for r in splitter.feed(cut[i:i + size])]
    assert not splitter.ended and [json.loads(r) for r in found] == rows[:max(0, len(rows) - 1)]
    splitter = pieces.RecordSplitter()
    list(splitter.feed(text + "x"))
    assert splitter.odd


def test_texts_that_are_no_lists():
    for text in ("{}", "3", '"[', "x[1]"):
        splitter = pieces.RecordSplitter()
        assert not list(splitter.feed(text)) and splitter.odd
    splitter = pieces.RecordSplitter()
    assert not list(splitter.feed(" \n")) and not splitter.begun


def _documents(folder, packed=""):
    pack = {"": lambda b: b, ".gz": gzip.compress, ".bz2": bz2.compress}[packed]
    rows = [{"Key": i, "goldresp": 'a ] " \\ } é'} for i in range(500)]
    return rows, [
        put(folder, f"e{k}/trials.json{packed}", pack(json.dumps(rows[250 * k:250 * k + 250], indent=k or None).encode())) for k in range(2)
    ]


@pytest.mark.parametrize("packed", ["", ".gz", ".bz2"])
def test_large_documents_are_streamed(spark, folder, packed, monkeypatch):
    rows, paths = _documents(folder, packed)
    monkeypatch.setattr(pieces, "_CHUNK", 100)
    expected = records.read_json(spark, paths, SLIM, with_path=True)
    streamed = records.read_json(spark, paths, SLIM, with_path=True, large=10)
    plain = [(r.Key, r.goldresp, r["__row"]) for r in expected.collect()]
    assert sorted((r.Key, r.goldresp, r["__row"]) for r in streamed.collect()) == sorted(plain) and len(plain) == 500
    with pytest.raises(ValueError, match="schema"):
        records.read_json(spark, paths, large=10)


def test_only_large_documents_are_streamed(spark, folder):
    small = put(folder, "s.json", json.dumps({"Key": {"0": 1}}))
    big = put(folder, "b.json", json.dumps([{"Key": 2 + i, "goldresp": "x" * 50} for i in range(100)]))
    assert _keys(records.read_json(spark, [small, big], SLIM, large=200)) == list(range(1, 102))
    with pytest.raises(Exception, match="neither a list"):
        records.read_json(spark, [small, big], SLIM, large=5).collect()
    broken = put(folder, "c.json", json.dumps([{"Key": 1}] * 50)[:-4])
    with pytest.raises(Exception, match="broken off"):
        records.read_json(spark, broken, SLIM, large=5).collect()


def test_what_is_left_out_of_documents_is_counted(spark, folder):
    texts = {
        "whole": '[{"Key": 1}, {"Key": 2}]', "bad": '[{"Key": 3}, {"Key": x}, {"Key": "y"}, {"Key": 4}]', "cut": '[{"Key": 5}, {"Key": 6}, {"Ke',
        "columns": '{"Key": {"0": 7}}', "odd": "3", "brokencolumns": '{"Key": {"0": 1',
    }
    paths = [put(folder, f"{name}.json", text) for name, text in texts.items()]
    left = records.read_json(spark, paths, SLIM, skip_corrupt=True)
    assert _keys(left) == list(range(1, 8))
    found = {os.path.basename(r.path)[:-5]: (r.n_records, r.n_corrupt) for r in eg.corrupt_documents(spark, paths, SLIM).collect()}
    assert found == {"whole": (2, 0), "bad": (4, 2), "cut": (3, 1), "columns": (1, 0), "odd": (1, 1), "brokencolumns": (1, 1)}


_CELLS = st.dictionaries(st.text('a"\\\'[]{},: é', max_size=3), st.one_of(
    st.none(), st.integers(), st.booleans(), st.text('b"\\\'[]{},: 🙂', max_size=5), st.lists(st.text(",]}'", max_size=2), max_size=2),
    st.dictionaries(st.text("}],", max_size=2), st.integers(), max_size=2),
), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.text('k"\\\'{},', max_size=3), st.one_of(st.none(), _CELLS), max_size=4), st.integers(1, 9), st.integers(0, 12), st.sampled_from([None, 2]), st.booleans())
def test_parts_of_an_object_of_columns(columns, size, most, indent, escaped):
    text = " " + json.dumps(columns, indent=indent, ensure_ascii=escaped) + "\n "
    splitter = pieces.ColumnSplitter(most)
    found = [r for i in range(0, len(text), size) for r in splitter.feed(text[i:i + size])]
    assert splitter.ended and not splitter.odd
    joined = {}
    for first, part in found:
        (name, cells), = json.loads(part).items()
        if cells is None:
            joined[name] = None
        else:
            assert first == len(joined.setdefault(name, {}))
            joined[name] |= cells
    assert joined == columns
    cut = text.rstrip()[:-1]
    splitter = pieces.ColumnSplitter(most)
    list(splitter.feed(cut))
    assert not splitter.ended


_OBJECTS = {
    "columns": '{"Key": {"0": 7, "1": 8, "2": 9}, "goldresp": {"1": "b, }", "0": "a"}}', "single": "{'Key': {'0': 10}, 'goldresp': {'0': 'a}\"b'}}",
    "nothing": '{"Key": null, "goldresp": {}}', "twice": '{"Key": {"0": 11, "0": 12}, "Key": {"1": 13}}', "behind": '{"Key": {"0": 14}} x',
    "cut": '{"Key": {"0": 1, "1": 2', "cell": '{"Key": {"0": 1, "1": x, "2": 3}}', "comma": '{"Key": {"0": 1,}}', "commas": '{"Key": {"0": 1,, "1": 2}}',
    "last": '{"Key": {"0": 1},}', "between": '{"Key": {"0": 1} "goldresp": {}}', "list": '{"Key": {"0": 1}, "goldresp": ["a"]}', "bracket": '{"Key": {"0": 1]}',
    "number": '{"Key": {"0": 1}, "goldresp": 3}', "name": '{"Key": {"0": 1}, goldresp: {"0": "a"}}', "depth": '{"Key": {"0": [1}}}',
}
_WHOLE_OBJECTS = {"columns", "single", "nothing", "twice", "behind"}


@pytest.mark.parametrize("packed", [False, True])
def test_objects_of_columns_of_any_size_are_read_and_counted(spark, folder, monkeypatch, packed):
    pack, ending = (gzip.compress, ".json.gz") if packed else (bytes, ".json")
    texts = _OBJECTS | {"records": '[{"Key": 15}, {"Key": x}]'}
    paths = [put(folder, f"{name}{ending}", pack(text.encode())) for name, text in texts.items()]
    seen = []
    for most in (records.LARGE, 10):
        # a document over this size was left out, and counted as corrupt
        monkeypatch.setattr(records, "LARGE", most)
        monkeypatch.setattr(pieces, "_PART_CHARS", most)
        monkeypatch.setattr(pieces, "_CHUNK", min(most, 1 << 20))
        rows = records.read_json(spark, paths, SLIM, skip_corrupt=True, with_path=True)
        kept = sorted((r.Key, r.goldresp or "", r["__row"]) for r in rows.collect())
        counted = {os.path.basename(r.path).partition(".")[0]: (r.n_records, r.n_corrupt) for r in eg.corrupt_documents(spark, paths, SLIM).collect()}
        seen.append((kept, counted))
    assert seen[0] == seen[1]
    assert kept == [(7, "a", 0), (8, "b, }", 0), (9, "", 2), (10, 'a}"b', 0), (12, "", 0), (13, "", 0), (14, "", 0), (15, "", 0)]
    assert counted == {name: (1, int(name not in _WHOLE_OBJECTS)) for name in _OBJECTS} | {"records": (2, 1)}
