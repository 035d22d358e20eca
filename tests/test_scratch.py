import glob
import os
import shutil
import subprocess
import sys
import threading

from millrace import scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _there(path):
    return os.path.isdir(path.removeprefix("file://"))


def test_tables_go_with_their_scope_and_kept_ones_stay(spark):
    with scratch.temporary(spark) as outer:
        with scratch.temporary(spark) as inner:
            _, gone = scratch.write_table(spark.range(3), "a")
            table, kept = scratch.write_table(spark.range(4), "b")
            inner.keep(kept)
        assert not _there(gone) and _there(kept) and table.count() == 4 and outer.paths == [kept]
    assert not _there(kept)


def test_scopes_of_other_threads_are_left_alone(spark):
    started, done, paths = threading.Event(), threading.Event(), []

    def other():
        with scratch.temporary(spark):
            paths.append(scratch.write_table(spark.range(5), "other")[1])
            started.set()
            done.wait(60)
            paths.append(_there(paths[0]))

    thread = threading.Thread(target=other)
    thread.start()
    with scratch.temporary(spark):
        scratch.write_table(spark.range(2), "mine")
        assert started.wait(60)
    assert _there(paths[0])
    done.set()
    thread.join()
    assert paths[1] is True and not _there(paths[0])


def test_entry_without_the_corpus_operators(tmp_path):
    for path in ["__spark_entry__.py", "bench.py", *glob.glob("millrace/**/*.py", root_dir=ROOT, recursive=True)]:
        if not path.startswith("millrace/llm"):
            os.makedirs(os.path.dirname(tmp_path / path), exist_ok=True)
            shutil.copy(os.path.join(ROOT, path), tmp_path / path)
    os.makedirs(tmp_path / "millrace/llm/__pycache__")  # what a deleted package may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x.startswith('op') or x == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True, timeout=120)
