"""Outcomes of fetching: copies, failures, repeats, files cut short, a server that fails at first."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from geomill.sources import clouds, fetch


def test_outcomes(spark, tmp_path):
    d = spark.createDataFrame([(float(i), 1.0, 2.0, 3) for i in range(40)], "x double, y double, z double, classification int")
    clouds.write(d, str(tmp_path / "c"), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)).collect()
    raw = max((tmp_path / "c").glob("*.las"), key=lambda p: p.stat().st_size).read_bytes()
    packed = bytearray(raw)
    packed[104] |= 0x80
    packed[375:383] = (len(raw) - 8).to_bytes(8, "little")
    src, out = tmp_path / "s", tmp_path / "o"
    src.mkdir()
    out.mkdir()
    for name, body in (("a.las", raw), ("cut.las", raw[:-1]), ("head.las", raw[:90]), ("p.laz", packed), ("pcut.laz", packed[:-9]), ("t.tif", b"x"), ("e.tif", b"")):
        (src / name).write_bytes(bytes(body))
    (out / "old.las").write_bytes(raw)
    (out / "bad.las").write_bytes(raw[:-5])
    at = {n: f"file://{src}/{n}" for n in ("a.las", "cut.las", "head.las", "p.laz", "pcut.laz", "t.tif", "e.tif", "gone.las")}
    rows = [*at.items(), ("old.las", at["a.las"]), ("bad.las", str(src / "a.las")), ("a.las", at["a.las"]), (None, "x"), ("", "x"), ("../u", at["a.las"]), ("n", None)]
    for again in (False, True):
        got = fetch.fetched(spark.createDataFrame(rows, "name string, url string"), str(out)).collect()
        assert len(got) == len(rows)
        ok = sorted((r.name, r.skipped) for r in got if r.ok)
        assert ok == sorted([("a.las", again), ("a.las", True), ("p.laz", again), ("t.tif", again), ("old.las", True), ("bad.las", again)])
        error = {r.name: r.error for r in got if not r.ok}
        assert error["cut.las"] == error["head.las"] == error["pcut.laz"] == "cut short" and error["e.tif"] == "empty" and all(error.values())
        assert sorted(p.name for p in out.iterdir()) == ["a.las", "bad.las", "old.las", "p.laz", "t.tif"]
        assert (out / "bad.las").read_bytes() == raw


def test_server_that_fails_at_first(spark, tmp_path):
    seen: dict[str, int] = {}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            n = seen[self.path] = seen.get(self.path, 0) + 1
            good = self.path == "/late" and n == 3 or self.path == "/short"
            self.send_response(200 if good else 503)
            self.send_header("Content-Length", "7")
            self.end_headers()
            self.wfile.write(b"content" if self.path != "/short" else b"con")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    links = spark.createDataFrame([(k, f"{base}/{k}") for k in ("late", "never", "short")], "name string, url string")
    got = {r.name: r for r in fetch.fetched(links, str(tmp_path), pause=0.01, timeout=10).collect()}
    server.shutdown()
    assert got["late"].ok and got["late"].attempts == 3 and got["late"].bytes == 7 and (tmp_path / "late").read_bytes() == b"content"
    assert not got["never"].ok and got["never"].attempts == 3 and seen["/never"] == 3 and not got["short"].ok
    assert [p.name for p in tmp_path.iterdir()] == ["late"]
