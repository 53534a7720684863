"""Readers on hand-written files."""

import pytest

from assay.sources import readers


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_manifest_csv_with_byte_order_mark(spark, tmp_path):
    f = tmp_path / "m.csv"
    write(f, "﻿path,label,split,group\na/x.png, cat ,Val,g1\n/abs/y.png,dog,, \n")
    rows = {r["path"]: (r["label"], r["split"], r["grp"]) for r in readers.scan_manifest_csv(spark, str(f), "/root/c").collect()}
    assert rows == {"/root/c/a/x.png": ("cat", "valid", "g1"), "/abs/y.png": ("dog", "train", None)}


def test_manifest_csv_errors(spark, tmp_path):
    write(tmp_path / "a.csv", "path,split\nx,train\n")
    with pytest.raises(ValueError, match="label"):
        readers.scan_manifest_csv(spark, str(tmp_path / "a.csv"), "/c")
    write(tmp_path / "b.csv", "path,label\nx, \n")
    with pytest.raises(Exception, match="blank label"):
        readers.scan_manifest_csv(spark, str(tmp_path / "b.csv"), "/c").collect()


def test_class_folders(spark, tmp_path):
    for p in ("Training/cat/1.png", "Training/dog/sub/2.JPG", "test/cat/3.png", ".hidden/cat/4.png", "test/dog/notes.txt"):
        write(tmp_path / "tree" / p, "x")
    d = readers.scan_class_folders(spark, str(tmp_path / "tree"))
    got = sorted((r["path"].rsplit("/", 1)[1], r["label"], r["split"]) for r in d.collect())
    assert got == [("1.png", "cat", "train"), ("2.JPG", "dog", "train"), ("3.png", "cat", "test")]
    assert "content" not in d._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    write(tmp_path / "tree" / "train/cat/5.png", "x")
    with pytest.raises(ValueError, match="several folders"):
        readers.scan_class_folders(spark, str(tmp_path / "tree"))


def test_predictions_without_probabilities(spark, tmp_path):
    write(tmp_path / "p.csv", "fold,method,path,patient_id,y_true,y_pred\n1,a,f,007,0,1\n")
    r = readers.scan_predictions(spark, str(tmp_path / "p.csv")).first()
    assert r["patient_id"] == "007" and r["y_pred"] == 1
    write(tmp_path / "q.csv", "fold,method,path,patient_id,y_true,y_pred,p_0,p_2\n1,a,f,007,0,1,0.5,0.5\n")
    with pytest.raises(ValueError, match="incomplete"):
        readers.scan_predictions(spark, str(tmp_path / "q.csv"))


@pytest.mark.parametrize("root", ["brain+mri", "data/x/data", "a.b(c)"])
def test_class_folders_by_whole_prefix(spark, tmp_path, root):
    write(tmp_path / root / "test/cat/3.png", "x")
    write(tmp_path / root / "dog/4.png", "x")
    got = sorted((r["label"], r["split"]) for r in readers.scan_class_folders(spark, str(tmp_path / root)).collect())
    assert got == [("cat", "test"), ("dog", "train")]


def test_result_files_with_own_headers(spark, tmp_path):
    write(tmp_path / "r/a/selection_grid.csv", "spec,learner,fit_seconds\nA,svm,1.5\n\"B,b\",rf,2\n")
    write(tmp_path / "r/b/selection_grid.csv", "\ufefffit_seconds,extra,spec\n3.5,q,C\n")
    write(tmp_path / "r/b/other.csv", "spec,learner\nno,no\n")
    write(tmp_path / "r/c/selection_grid.csv/part-0.csv", "spec,learner,fit_seconds\nD,nn,\n")
    got = sorted(tuple(r)[1:] for r in readers.scan_result_files(spark, str(tmp_path / "r")).collect())
    assert got == [(1, "A", "svm", 1.5), (1, "C", None, 3.5), (1, "D", "nn", None), (2, "B,b", "rf", 2.0)]
    with pytest.raises(ValueError, match="no nothing.csv"):
        readers.scan_result_files(spark, str(tmp_path / "r"), "nothing.csv")


def test_whole_manifest_document(spark, tmp_path):
    import hashlib
    import json

    def stamped(d):
        body = "".join(f"{f}\0{y}\n" for f, y in zip(d["files"], d["labels"]))
        return {**d, "digest": hashlib.md5(body.encode()).hexdigest()}

    role = lambda r, files: {"bed": "b", "role": r, "root": "/d", "class_names": ["cat", "dog"], "files": files, "labels": [i % 2 for i in range(len(files))],
                             "source_bed": "raw", "source_splits": ["Training"] * len(files), "source_rows": list(range(10, 10 + len(files))), "group_unit": "id",
                             "groups": ["g" + f for f in files], "recipe": {"x": 1}, "digest": "d" + r}
    doc = {"bed": "b", "root": "/d", "class_names": ["cat", "dog"], "group_unit": "id", "seed": 7, "built_at": "t", "builder": "me",
           "splits": {"train": stamped(role("train", ["a", "b", "c"])), "test": stamped(role("test", ["z"]))}, "audit": {}}
    write(tmp_path / "m.json", json.dumps(doc, indent=2))
    got = {(r["role"], r["pos"]): r for r in readers.scan_whole_manifest(spark, str(tmp_path / "m.json")).collect()}
    r = got["train", 2]
    assert len(got) == 4 and (r["path"], r["y"], r["label"], r["grp"], r["source_split"], r["source_row"], r["seed"]) == ("c", 0, "cat", "gc", "Training", 12, 7)
    doc["splits"]["test"]["source_rows"] = []
    write(tmp_path / "n.json", json.dumps(doc))
    with pytest.raises(Exception, match="unequal length"):
        readers.scan_whole_manifest(spark, str(tmp_path / "n.json")).collect()
    doc["splits"]["test"] = stamped(role("test", ["z"]))
    doc["splits"]["train"]["files"] = ["a", "x", "c"]
    write(tmp_path / "e.json", json.dumps(doc))
    with pytest.raises(Exception, match="digest mismatch: b/train"):
        readers.scan_whole_manifest(spark, str(tmp_path / "e.json")).collect()
    assert readers.scan_whole_manifest(spark, str(tmp_path / "e.json"), verify=False).count() == 4
    stale = readers.scan_manifest_digests(spark, str(tmp_path / "e.json")).where("recorded <> recomputed").collect()
    assert [(r["role"], r["entries"]) for r in stale] == [("train", 3)]
    del doc["splits"]["train"]["digest"]  # nothing recorded, nothing to hold it against
    write(tmp_path / "f.json", json.dumps(doc))
    assert readers.scan_whole_manifest(spark, str(tmp_path / "f.json")).count() == 4
