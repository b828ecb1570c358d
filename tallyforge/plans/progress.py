"""Lines of progress for long runs, and a question before an automatic choice of columns is used."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Sequence

from tallyforge.plans.state import current


def interactive() -> bool:
    return bool(getattr(sys, "ps1", None)) or sys.stdin is not None and sys.stdin.isatty()


def wanted(option: str) -> bool:
    """An option of true, false or auto; auto means in an interactive session."""
    value = current().option(option)
    return interactive() if value == "auto" else bool(value) and str(value).lower() != "false"


class Progress:
    """``item`` says which of ``total`` items is done and how long the rest may take."""

    def __init__(self, total: int, what: str = "", out: Callable[[str], None] | None = None):
        self.total, self.done_items, self.began = total, 0, time.monotonic()
        self.out = out or (lambda line: print(line, file=sys.stderr))
        self.on = wanted("progress")
        if self.on and what:
            self.out(f"{what}: {total}")

    def item(self, label: str) -> None:
        self.done_items += 1
        if self.on:
            left = (time.monotonic() - self.began) / self.done_items * (self.total - self.done_items)
            self.out(f"[{self.done_items}/{self.total}] {label}" + (f" (about {left_text(left)} left)" if self.done_items < self.total else ""))

    def done(self) -> None:
        if self.on:
            self.out(f"done in {left_text(time.monotonic() - self.began)}")


def left_text(seconds: float) -> str:
    return f"{seconds:.0f}s" if seconds < 90 else f"{seconds / 60:.0f}m"


def confirm_selection(names: Sequence[str], what: str, ask: Callable[[str], str] = input) -> bool:
    """Whether to go on with columns that were chosen automatically: asked where the option says so."""
    if not wanted("confirm"):
        return True
    return ask(f"{what}: {', '.join(names)}. Go on? [Y/n] ").strip().lower() in ("", "y", "yes")
