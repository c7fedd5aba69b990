"""Parameters of a run over planar 4:2:0 video, with defaults and checks."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from dataclasses import dataclass

BLOCK = 32


@dataclass(frozen=True)
class VideoParameters:
    width: int
    height: int
    frames: int = 1
    fps: int = 30
    qp: int = 32
    tile_cols: int = 1
    tile_rows: int = 1

    def __post_init__(self) -> None:
        if self.width <= 0 or self.height <= 0 or self.width % BLOCK or self.height % BLOCK:
            raise ValueError(f"width and height must be multiples of {BLOCK}")
        if self.frames < 1:
            raise ValueError("at least one frame is needed")
        if not 1 <= self.tile_cols <= self.width // BLOCK or not 1 <= self.tile_rows <= self.height // BLOCK:
            raise ValueError("each tile needs a block of its own")

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * 3 // 2


def parse(argv: Sequence[str]) -> tuple[str, VideoParameters]:
    """Path and parameters from a command line; fps and QP outside their ranges fall back to the defaults."""
    p = argparse.ArgumentParser(prog="tilework")
    p.add_argument("-i", "--input", required=True)
    for short, name in (("-w", "width"), ("-ht", "height")):
        p.add_argument(short, f"--{name}", type=int, required=True)
    p.add_argument("--frames", type=int, default=1)
    p.add_argument("--fps", type=int, default=30)
    p.add_argument("--qp", type=int, default=32)
    p.add_argument("--tiles", type=int, nargs=2, default=(1, 1), metavar=("COLS", "ROWS"))
    a = p.parse_args(argv)
    return a.input, VideoParameters(a.width, a.height, a.frames, a.fps if a.fps >= 1 else 30, a.qp if 1 <= a.qp <= 51 else 32, *a.tiles)
