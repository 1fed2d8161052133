import pytest
from logloom import config


def test_defaults():
    c = config.load(environ={})
    assert (c.net.port, c.net.max_connections, c.storage.max_file_size) == (6379, 128, 2 * 1024**3)
    assert (c.storage.merge.check_interval_ms, c.storage.merge.triggers.fragmentation) == (18000, 0.6)
    assert c.storage.merge.thresholds == config.Thresholds(0.4, 128 * config.MIB, 10 * config.MIB)


def test_file_and_environment(tmp_path):
    f = tmp_path / "c.toml"
    f.write_text('net.host = "h"\nstorage.path = "db"\nstorage.sync.interval_ms = 500\nstorage.merge.policy.window.start = 0\nstorage.merge.policy.window.end = 7\n')
    c = config.load(str(f), {"LOGLOOM__NET__HOST": "127.0.0.1", "LOGLOOM__STORAGE__MAX_FILE_SIZE": "2", "OTHER__NET__PORT": "1"})
    assert (c.net.host, c.net.port, c.storage.max_file_size, c.storage.sync, c.storage.merge.policy) == ("127.0.0.1", 6379, 2, 500, (0, 7))


@pytest.mark.parametrize(
    "text",
    [
        'net.host = "h"\n',
        'net.host = "h"\nstorage.x = 1\n',
        'net.port = "x"\nstorage.path = "p"\n',
        'net.port = 1\nstorage.merge.triggers.fragmentation = 0.1\n',
        'net.port = 1\nstorage.merge.policy = "sometimes"\n',
        "net.port = 1\nstorage.merge.policy.window.start = 0\nstorage.merge.policy.window.end = 24\n",
        "net.port = 1\nstorage.max_file_size = 0\n",
    ],
)
def test_bad_files(tmp_path, text):
    f = tmp_path / "c.toml"
    f.write_text(text)
    with pytest.raises(config.ConfigError):
        config.load(str(f), {})
