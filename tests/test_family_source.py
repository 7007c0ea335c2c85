"""The source of generation files: pruned files, mixed headers, CSV and HTML."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chainaug.sources import family as FM

ROWS = T.StructType([T.StructField("index", T.LongType()), T.StructField("generation", T.StringType())])
KEYS = {"round": (r"aug_num_(\d+)", T.IntegerType()), "fold": (r"kfold_(\d+)", T.IntegerType()), "target": (r"/(\w+)_aug", T.StringType())}


@pytest.fixture()
def folder(tmpdir_path):
    texts = {
        "prem1_aug_num_1_kfold_0.csv": ',index,generation\n0,17,hello\n1,18,"x, ""y""\nsecond line"\n',
        "prem1_aug_num_1_kfold_1.csv": "generation,index\nswapped,20\n",
        "prem2_aug_num_2_kfold_0.csv": 'index,generation,label\n21,"",gold\n22, blanks kept ,gold\n',
        "prem2_aug_num_2_kfold_1.csv": "index,generation\n",
        "prem2_aug_num_3_kfold_0.csv": "",
        "_SUCCESS": "", ".hidden_aug_num_1.csv": "index,generation\n1,no\n",
    }
    for name, text in texts.items():
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    return tmpdir_path


def test_columns_go_by_each_header_and_keys_by_the_name(spark, folder):
    df = FM.read_files(spark, folder, ROWS, KEYS)
    assert df.schema.simpleString() == "struct<index:bigint,generation:string,round:int,fold:int,target:string>"
    assert sorted(map(tuple, df.collect())) == [
        (17, "hello", 1, 0, "prem1"), (18, 'x, "y"\nsecond line', 1, 0, "prem1"), (20, "swapped", 1, 1, "prem1"),
        (21, None, 2, 0, "prem2"), (22, " blanks kept ", 2, 0, "prem2")]
    assert FM.read_files(spark, f"{folder}/*kfold_1.csv", ROWS, KEYS).count() == 1
    assert FM.read_files(spark, f"{folder}/prem1_aug_num_1_kfold_1.csv", ROWS).collect() == [(20, "swapped")]
    assert FM.read_files(spark, f"{folder}/nothing*.csv", ROWS, KEYS).count() == 0


@pytest.mark.parametrize("only, files, n", [
    ({"round": [2]}, 2, 2), ({"round": [1, 2], "fold": [1]}, 2, 1), ({"target": ["prem1"], "round": [1]}, 2, 3), ({"fold": [7]}, 0, 0), ({}, 5, 5)])
def test_a_file_that_is_not_asked_for_is_not_opened(spark, folder, only, files, n):
    if only:
        with open(os.path.join(folder, "prem1_aug_num_9_kfold_9.csv"), "w") as f:
            f.write("index,generation\nnot a number,x\n")
        with pytest.raises(Exception, match="not a number|conversion error"):
            FM.read_files(spark, folder, ROWS, KEYS).collect()
    df = FM.read_files(spark, folder, ROWS, KEYS, only)
    assert df.count() == n and df.rdd.getNumPartitions() == max(files, 1)


def test_a_frame_stays_whole_under_different_filters(spark, folder):
    df = FM.read_files(spark, folder, ROWS, KEYS)
    assert [df.where(w).count() for w in ("round = 1", "round = 2", "round in (1, 2) and fold = 1", "index > 17")] == [3, 2, 1, 4]
    assert df.count() == 5 and df.where("round = 1").union(df.where("round = 2")).count() == 5
    other = FM.read_files(spark, folder, ROWS, {"epoch": (r"epoch_(\d+)", T.IntegerType())})
    assert other.where("epoch is null").count() == 5 and other.where("epoch = 1").count() == 0
    with pytest.raises(ValueError, match="no key named epoch"):
        FM.read_files(spark, folder, ROWS, KEYS, {"epoch": [1]})


def test_html_tables_by_their_header(spark, tmpdir_path):
    page = ("<html><p>before</p><table border='1'><thead><tr><th></th><th>generation</th><th>index</th></tr></thead><tbody>"
            "<tr><td>0</td><td>a &lt; b &amp;amp; c</td><td>5</td></tr><tr><td>1</td><td> two\n words<td>6</tr><tr><td>2</td><td></td></tr>"
            "</tbody></table><table><tr><td>other</td></tr></table></html>")
    for name, text in (("run_1.html", page), ("run_2.html", "<p>no table</p>"), ("run_3.html", "")):
        with open(os.path.join(tmpdir_path, name), "w") as f:
            f.write(text)
    got = FM.read_files(spark, f"{tmpdir_path}/*.html", ROWS, {"run": (r"run_(\d+)", T.LongType())}, fmt="html").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(5, "a < b &amp; c", 1), (6, "two words", 1), (None, None, 1)], key=str)


def test_long_texts_and_many_rows(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "big_aug_num_1.csv"), "w") as f:
        f.write("index,generation\n" + "".join(f'{i},"{"word " * (200_000 if i == 7 else 3)}"\n' for i in range(5000)))
    df = FM.read_files(spark, tmpdir_path, ROWS, {"round": (r"num_(\d+)", T.IntegerType())})
    assert df.agg(F.count("index"), F.max(F.length("generation")), F.sum("round")).first() == (5000, 1_000_000, 5000)
