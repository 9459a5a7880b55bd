"""Logging and timing around actions."""

import logging
import time
from pathlib import Path

LEVELS = ("trace", "debug", "info", "warning", "error", "critical", "off")
_NUMBERS = {"trace": 5, "debug": 10, "info": 20, "warning": 30, "error": 40, "critical": 50, "off": 60}
logging.addLevelName(5, "TRACE")
_COLOURS = {5: "37", 10: "36", 20: "32", 30: "33", 40: "31", 50: "1;31"}


class _Coloured(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return f"\033[{_COLOURS.get(record.levelno, '0')}m{super().format(record)}\033[0m"


def logger(name: str = "layoutcheck", path: str | Path | None = None, console: bool = True, level: str = "info", colour: bool = False) -> logging.Logger:
    """A logger with an optional file sink and an optional console sink; seven levels from trace to off."""
    log = logging.getLogger(name)
    log.setLevel(_NUMBERS[level])
    log.propagate = False
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    form = "[%(asctime)s] [%(levelname)s] %(message)s"
    if path is not None:
        to_file = logging.FileHandler(path)
        to_file.setFormatter(logging.Formatter(form))
        log.addHandler(to_file)
    if console:
        to_screen = logging.StreamHandler()
        to_screen.setFormatter((_Coloured if colour else logging.Formatter)(form))
        log.addHandler(to_screen)
    return log


class Timer:
    """Milliseconds of running time; can be paused. As a context manager it logs at its end."""

    def __init__(self, name: str = "", log: logging.Logger | None = None):
        self.name, self.log = name, log
        self.reset()

    def reset(self) -> None:
        self._sum, self._since = 0.0, None

    def start(self) -> "Timer":
        if self._since is None:
            self._since = time.perf_counter()
        return self

    def pause(self) -> None:
        if self._since is not None:
            self._sum += time.perf_counter() - self._since
            self._since = None

    def elapsed(self) -> float:
        running = time.perf_counter() - self._since if self._since is not None else 0.0
        return (self._sum + running) * 1000

    def __enter__(self) -> "Timer":
        return self.start()

    def __exit__(self, *_) -> None:
        self.pause()
        if self.log is not None:
            self.log.info("%s: %.3f ms", self.name, self.elapsed())
