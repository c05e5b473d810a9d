"""pagemill: Spark jobs over pages, text lines, detections, page results, failed messages and timings."""

from pagemill.params import Params

__all__ = ["Params"]
