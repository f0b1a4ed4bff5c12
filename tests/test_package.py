"""The package on executors that do not have it: sent along, or missing."""

import os
import pathlib
import subprocess
import sys
import textwrap

REPO = pathlib.Path(__file__).resolve().parents[1]


def run(tmp_path, shipped):
    script = tmp_path / "job.py"
    script.write_text(textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(REPO)!r})
        from pyspark.sql import functions as F
        from ebbtide.operators import messages
        from ebbtide.session import local_session, ship
        spark = local_session("2", 2, "1g")
        {"ship(spark)" if shipped else ""}
        rows = spark.createDataFrame([(1, "late again"), (2, "")], "msg_id long, text string")
        print("ROWS", messages.embed_messages(rows).filter("embedding IS NOT NULL").count())
    """))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)


def test_an_arrow_operator_runs_from_another_folder(tmp_path):
    done = run(tmp_path, True)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_without_it_the_workers_cannot_import(tmp_path):
    done = run(tmp_path, False)
    assert "ROWS" not in done.stdout and "No module named 'ebbtide'" in done.stderr
