"""Workers find the package although only the driver's path names it."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from raceflow.session import build_session, ship_package
spark = build_session("ship", "local[2]")
for _ in range(2):
    ship_package(spark)

def named(batches):
    import raceflow.registry
    for b in batches:
        b["id"] = len(raceflow.registry.__name__)
        yield b

print("got", [r[0] for r in spark.range(3).mapInPandas(named, "id long").collect()])
"""


def test_package_reaches_workers(tmp_path):
    script = tmp_path / "job.py"
    script.write_text(SCRIPT.format(root=ROOT))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "got [17, 17, 17]" in out.stdout, out.stderr[-2000:]
