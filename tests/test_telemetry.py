import io
import json
import logging

from logloom import config, telemetry


def test_events_are_lines_of_json():
    out = io.StringIO()
    handler = telemetry.start("INFO", out)
    log = logging.getLogger("logloom.some")
    try:
        log.debug("too quiet")
        log.info("merged %d files", 3, extra={"root": "/s"})
        try:
            raise RuntimeError("lost")
        except RuntimeError:
            log.exception("failed")
        telemetry.start("INFO", out)
        log.info("once")
    finally:
        logger = logging.getLogger("logloom")
        for h in [h for h in logger.handlers if isinstance(h.formatter, telemetry.JsonLines)]:
            logger.removeHandler(h)
        logger.setLevel(logging.NOTSET)
    lines = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [x["message"] for x in lines] == ["merged 3 files", "failed", "once"] and handler not in logger.handlers
    assert lines[0]["root"] == "/s" and lines[0]["level"] == "INFO" and lines[0]["target"] == "logloom.some"
    assert "RuntimeError: lost" in lines[1]["error"]


def test_settings_without_effect_are_told(tmp_path, caplog):
    f = tmp_path / "c.toml"
    f.write_text('net.port = 1\nnet.max_connections = 5\nstorage.readers_cache_size = 3\n')
    with caplog.at_level("WARNING", "logloom.config"):
        config.load(str(f), {})
    assert [r.getMessage().split(" has")[0] for r in caplog.records] == ["net.port", "storage.readers_cache_size"]
