"""``python -m rasterweave -cpu photo.bmp --filter=gg``: reads below ``test-img``, writes there."""

from __future__ import annotations

import logging
import sys

from rasterweave.plans.config import parse_args
from rasterweave.session import get_spark
from rasterweave.streaming.pipeline import run


def main(argv: list[str], folder: str = "test-img") -> float:
    config = parse_args(argv)
    took = run(get_spark(config.threads if config.threads > 1 else None), config, folder, folder, "timings" if config.log else None)
    logging.getLogger("rasterweave").info("%s on %s took %.6f s", config.filter, ", ".join(config.files), took)
    return took


if __name__ == "__main__":
    logging.basicConfig(level=logging.INFO)
    main(sys.argv[1:])
