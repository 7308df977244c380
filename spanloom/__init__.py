"""Source citations at scale: resolve, hash, store, re-resolve and query them with Spark."""

from .errors import StoreError, TargetStoreError, TransformationError
from .model import ResolutionStatus, ResolutionStatus as Status
from .operators.annotate import annotate_svg, annotate_xpath
from .operators.drift import check_drift, check_svg_drift, check_xpath_drift
from .plans.store import CitationStore
from .plans.transform import Transformation, apply_transformation, text_renderer, workbook_renderer
from .plans.transform import get as get_transformation
from .plans.transform import register as register_transformation

__all__ = [
    "CitationStore",
    "ResolutionStatus",
    "Status",
    "StoreError",
    "TargetStoreError",
    "Transformation",
    "TransformationError",
    "annotate_svg",
    "annotate_xpath",
    "apply_transformation",
    "check_drift",
    "check_svg_drift",
    "check_xpath_drift",
    "get_transformation",
    "register_transformation",
    "text_renderer",
    "workbook_renderer",
]
