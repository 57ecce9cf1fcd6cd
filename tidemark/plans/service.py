"""Runs as services: whether a run's process still lives, heartbeats to a watchdog, and a unit to start a study by."""

from __future__ import annotations

import os
import shlex
import socket
import time
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from . import runner


def alive(events: Sequence[Mapping]) -> bool:
    """Whether the process that began the run is there. On another host, or unnamed, that can't be seen: it counts as alive."""
    began = next((e for e in events if e["kind"] == "run_started"), {})
    if "pid" not in began or began.get("host") != socket.gethostname():
        return True
    try:
        os.kill(began["pid"], 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        pass
    return True


def run_alive(root: Path) -> Callable[[str], bool]:
    return lambda run: alive(runner.read_events(root / "runs" / run / "events.jsonl")[0])


def notify(message: str, environ: Mapping[str, str] = os.environ) -> bool:
    """Sends a datagram to the service manager, if it asked for them."""
    address = environ.get("NOTIFY_SOCKET")
    if not address:
        return False
    with socket.socket(socket.AF_UNIX, socket.SOCK_DGRAM) as s:
        s.connect("\0" + address[1:] if address.startswith("@") else address)
        s.sendall(message.encode())
    return True


class Heartbeat:
    """A listener of a run: tells the watchdog of every event, at most once a second, so a run that stands still is killed."""

    def __init__(self, send: Callable[[str], object] = notify, clock: Callable[[], float] = time.monotonic):
        self.send, self.clock, self.last = send, clock, -1.0

    def __call__(self, event: Mapping) -> None:
        if event["kind"] == "run_started":
            self.send("READY=1")
        elif event["kind"] == "stage":
            self.send(f"STATUS={event['stage']} {event['status']}")
        if self.clock() - self.last >= 1:
            self.last = self.clock()
            self.send("WATCHDOG=1")


def unit(command: Sequence[str], name: str, watchdog: int = 3600, folder: str = "") -> str:
    """A service unit that runs the command once and is killed after `watchdog` seconds without an event."""
    lines = ["[Unit]", f"Description={name}", "", "[Service]", "Type=notify", "NotifyAccess=all", f"WatchdogSec={watchdog}", f"ExecStart={shlex.join(command)}"]
    return "\n".join([*lines, *([f"WorkingDirectory={folder}"] if folder else [])]) + "\n"
