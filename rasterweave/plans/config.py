"""Run settings and the command line."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

from rasterweave.functions.catalog import FILTERS
from rasterweave.functions.scalars import BACKENDS, COMPUTE_MODES, EXEC_MODES


@dataclass(frozen=True)
class RunConfig:
    """What one run does. ``queue_size`` counts images, ``queue_mem`` is MiB."""

    files: tuple[str, ...]
    filter: str
    backend: str = "CPU"
    exec_mode: str = "normal"
    compute_mode: str = "by_row"
    block: int = 64
    threads: int = 1
    rww: tuple[int, int, int] = (1, 1, 1)
    queue_size: int = 20
    queue_mem: int = 500
    output: str | None = None
    log: bool = False
    passes: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        for value, known, what in ((self.filter, tuple(FILTERS), "filter"), (self.compute_mode, COMPUTE_MODES, "mode"), (self.exec_mode, EXEC_MODES, "execution mode"), (self.backend, BACKENDS, "backend")):
            if value not in known:
                raise ValueError(f"unknown {what} {value!r}; there are {', '.join(known)}")
        if not self.files:
            raise ValueError("no input file")
        if self.exec_mode != "queue" and len(self.files) != 1:
            raise ValueError("only queue mode takes several files")
        if self.block < 1 or self.threads < 1 or min(self.rww) < 1 or self.queue_size < 1 or self.queue_mem < 1:
            raise ValueError("counts and sizes are positive")
        if self.backend == "GPU" and self.exec_mode == "queue":
            raise ValueError("the GPU backend has no queue mode")
        if self.exec_mode == "mpi" and self.compute_mode not in ("by_row", "by_column"):
            raise ValueError("distributed mode splits by row or column")


def parse_args(argv: list[str]) -> RunConfig:
    """``-cpu|-gpu [-queue|-mpi] FILE... --filter=.. --mode=.. --block=.. --threadnum=.. --rww=R,W,W --queue-size=.. --queue-mem=.. --output=.. --log``"""
    p = argparse.ArgumentParser(prog="rasterweave", allow_abbrev=False)
    p.add_argument("files", nargs="+")
    kind = p.add_mutually_exclusive_group(required=True)
    kind.add_argument("-cpu", dest="backend", action="store_const", const="CPU")
    kind.add_argument("-gpu", dest="backend", action="store_const", const="GPU")
    how = p.add_mutually_exclusive_group()
    how.add_argument("-queue", "-queue-mode", dest="exec_mode", action="store_const", const="queue", default="normal")
    how.add_argument("-mpi", "-mpi-mode", dest="exec_mode", action="store_const", const="mpi")
    p.add_argument("--filter", required=True)
    p.add_argument("--mode", dest="compute_mode", default="by_row")
    p.add_argument("--block", type=int, default=64)
    p.add_argument("--threadnum", dest="threads", type=int, default=1)
    p.add_argument("--rww", type=lambda s: tuple(int(x) for x in s.split(",")), default=(1, 1, 1))
    p.add_argument("--queue-size", type=int, default=20)
    p.add_argument("--queue-mem", type=int, default=500)
    p.add_argument("--output")
    p.add_argument("--log", action="store_true")
    a = vars(p.parse_args(argv))
    return RunConfig(**(a | {"files": tuple(a["files"]), "exec_mode": a["exec_mode"] or "normal"}))
