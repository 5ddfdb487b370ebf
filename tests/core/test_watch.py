import datetime as dt
import threading
import time

from quarry.engine import Config, Engine, Source
from quarry.streaming.watch import periodic, watch
from tests.core.test_index import write


def test_a_burst_is_one_run(spark, tmp_path):
    write(tmp_path, {"d/old.md": "old words"})
    e = Engine(spark, str(tmp_path / "index"), Config((Source("d", "design", str(tmp_path / "d")),)), lambda: dt.date(2026, 9, 28))
    heard = []
    q = watch(spark, e, told=heard.append)
    until = time.time() + 240
    while not heard and time.time() < until:
        time.sleep(0.2)
    assert [r["indexed"] for r in heard] == [1]
    for i in range(4):
        write(tmp_path, {f"d/{i} [x].md": f"burst {i}"})
        time.sleep(0.1)
    while len(heard) < 2 and time.time() < until:
        time.sleep(0.2)
    assert [r["indexed"] for r in heard] == [1, 4] and heard[1]["discovered"] == 4
    q.stop()
    # the checkpoint lies beside the index: another start doesn't begin anew
    write(tmp_path, {"d/late.md": "late"})
    q = watch(spark, e, told=heard.append)
    while len(heard) < 3 and time.time() < until + 120:
        time.sleep(0.2)
    assert heard[2]["indexed"] == 1 and heard[2]["discovered"] == 1
    q.stop()
    (tmp_path / "d" / "late.md").unlink()
    stop, scans = threading.Event(), []
    t = periodic(e, stop, scans.append, first=0.01)
    while not scans and time.time() < until + 240:
        time.sleep(0.2)
    stop.set()
    t.join(120)
    assert scans[0]["deleted"] == 1
