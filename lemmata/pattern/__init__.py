"""Written patterns such as `Real.exp _ ≤ _`, read into queries."""

from .reading import Known, Reading, applied_constants, parse, powers_of_statement

__all__ = ["Known", "Reading", "applied_constants", "parse", "powers_of_statement"]
