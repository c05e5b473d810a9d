"""Thresholds of the page jobs. Every operator takes them as an argument; nothing reads a config file."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Defaults that decide results.
    # text lines
    line_min_confidence: float = 0.70
    extent_margin: float = 1.1
    extent_default: int = 2000
    lines_max_side: int = 3500
    min_dpi: int = 300
    # capture type
    capture_enabled: bool = True
    white_level: int = 245
    white_fraction: float = 0.70
    # geometry
    crop_enabled: bool = True
    skip_crop_if_scan: bool = True
    crop_max_area_ratio: float = 0.85
    crop_min_margin_ratio: float = 0.08
    deskew_enabled: bool = True
    deskew_call_angle: float = 0.1
    deskew_min_angle: float = 0.5
    deskew_min_confidence: float = 0.20
    deskew_max_angle: float = 15.0
    deskew_tolerance: float = 1.0
    orientation_min_confidence: float = 0.70
    # quality
    min_contrast: float = 50.0
    min_width: int = 1200
    min_height: int = 1600
    rotation_epsilon: float = 0.1
    deskew_shown_angle: float = 0.1
    orientation_good: float = 0.70
    deskew_good: float = 0.75
    deskew_fair: float = 0.40
    skewed_percent: float = 30.0
    outlier_percent: float = 50.0
    # classification
    class_min_confidence: float = 0.60
    # documents
    document_deadline_s: int = 300
    page_deadline_s: float = 30.0
    stale_after_s: int = 3600
    result_ttl_s: int = 86400
    failed_ttl_s: int = 7 * 86400
    task_retention_s: int = 24 * 3600
    file_retention_s: int = 3600
    max_retries: int = 3
    # training
    test_size: float = 0.2
    seed: int = 42


# Accepted file extensions, in their documented order.
LISTED_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")
UPLOAD_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tiff", ".bmp")

# Histogram bounds in seconds (the open last bucket is added by the operator).
PAGE_BOUNDS = (0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)
DOCUMENT_BOUNDS = PAGE_BOUNDS + (120.0, 300.0)
