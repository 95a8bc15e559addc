"""Scan options and their presets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

from .functions.text import TLDS
from .operators.detection import OcrEngine

# Resolutions and pyramid levels of the two presets.
DEFAULT_DPI, DEFAULT_SCALES = 400, (1.0, 0.6, 0.4, 0.25)
INTERACTIVE_DPI, INTERACTIVE_SCALES = 300, (1.0, 0.5, 0.25)


@dataclass(frozen=True)
class ScanOptions:
    """uri_filter maps a candidate's text to the link's target, or null to drop it; None is the default filter.
    tlds are the top-level domains that a bare domain may end in.  scales are the pyramid levels whose hits count, dpi is
    what renderers are asked for (see jobs.detector_tasks).  With an ocr_engine a scan reads pages itself."""

    dpi: int = DEFAULT_DPI
    scales: tuple[float, ...] = DEFAULT_SCALES
    uri_filter: Callable[[Column], Column] | None = None
    match_bare_domains: bool = False
    tlds: tuple[str, ...] = tuple(TLDS)
    ocr_engine: OcrEngine | None = None


DEFAULT = ScanOptions()
INTERACTIVE = ScanOptions(INTERACTIVE_DPI, INTERACTIVE_SCALES)
