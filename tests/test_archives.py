"""Zip archives of CSV files: entries in parallel, streamed, in order."""

import zipfile

import pytest

from duelgrid.operators.completions import model_outputs
from duelgrid.sources import archives, tables
from duelgrid.sources.order import in_load_order


@pytest.fixture
def archive(tmp_path):
    path = f"{tmp_path}/a.csv.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for part, n in (("b.csv", 12_000), ("a.csv", 3)):
            z.writestr(part, 'instruction_index,model,output\n' + "".join(f'{k % 100:04d},m,"{part} ""{k}""\nline"\n' for k in range(n)))
        z.writestr("c.csv", "model,instruction_index\nm,NA\n")
        z.writestr("__MACOSX/x", "junk")
    return path


def test_each_entry_is_a_partition_in_order(spark, archive):
    for path in (archive, f"file://{archive}"):
        df = tables.read_ordered(spark, path)
        assert df.rdd.getNumPartitions() == 3 and df.columns == ["instruction_index", "model", "output", "ord"]
        rows = df.orderBy("ord").collect()
        assert len(rows) == 12_004 and rows[0].output == 'a.csv "0"\nline' and rows[3].output == 'b.csv "0"\nline' and rows[-2].output == 'b.csv "11999"\nline'
        assert tuple(rows[-1])[:3] == ("NA", "m", None)


def test_the_last_output_is_that_of_the_last_entry(spark, archive):
    last = {r.instruction_index: r.completion for r in model_outputs(tables.read_ordered(spark, archive), "m").collect()}
    assert last["0007"] == 'b.csv "11907"\nline' and last["NA"] == ""


def test_types_and_odd_archives(spark, archive, tmp_path):
    typed = tables.read_table(spark, archive, "instruction_index int, output string")
    assert typed.dtypes == [("instruction_index", "int"), ("output", "string")] and typed.where("instruction_index is null").count() == 1
    with zipfile.ZipFile(f"{tmp_path}/empty.csv.zip", "w") as z:
        z.writestr("e.csv", "id,text\n")
    assert tables.read_table(spark, f"{tmp_path}/empty.csv.zip").count() == 0
    assert in_load_order(tables.read_table(spark, f"{tmp_path}/empty.csv.zip"), "place").count() == 0


def test_an_entry_is_read_as_a_stream(archive):
    with archives.opened(archive) as z, z.open("b.csv") as stream:
        sizes = [len(f) for f in archives.frames(stream)]
    assert sizes == [5000, 5000, 2000]
