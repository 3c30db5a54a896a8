"""Texts that hand a job to cron or to a systemd timer; nothing is installed, and the job itself runs with what is available now."""

from __future__ import annotations

import re
import shlex
from datetime import datetime

#: The fields of a unit file for each section, in its order.
SERVICE = {"Unit": ("Description",), "Service": ("Type", "ExecStart")}
TIMER = {"Unit": ("Description",), "Timer": ("OnCalendar", "Persistent"), "Install": ("WantedBy",)}
FORMATS = ("cron", "systemd")


def unit(layout: dict[str, tuple[str, ...]], **values: str) -> str:
    return "\n\n".join("\n".join([f"[{section}]", *[f"{k}={values[k]}" for k in keys]]) for section, keys in layout.items())


def schedule(command: list[str], name: str, time: str = "09:00", kind: str = "cron") -> dict[str, str]:
    """What it takes to run a command once a day: a crontab line, or the texts of a service and its timer. An unknown kind is cron."""
    if re.search(r"[^\w.-]", name) or not name:
        raise ValueError("a schedule's name is made of letters, digits, dots, dashes and underscores")
    at = datetime.strptime(time, "%H:%M")
    line = shlex.join(command)
    if kind != "systemd":
        return {"format": "cron", "cron": f"{at.minute} {at.hour} * * * {line} # {name}"}
    service = unit(SERVICE, Description=name, Type="oneshot", ExecStart=line)
    return {"format": kind, "service": service, "timer": unit(TIMER, Description=f"{name}, daily", OnCalendar=f"*-*-* {at:%H:%M}:00", Persistent="true", WantedBy="timers.target")}
