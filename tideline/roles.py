"""Column roles of a subject timeline.

``subject`` is the categorical Y axis (one lane per subject), ``x`` the linear
time axis, ``bar`` the duration drawn as one bar per subject.  ``overlays`` are
columns drawn as markers and ``keep`` extra columns carried into the plot table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Subject identifiers the subject role accepts, and the labels
# used when a role is missing.
SUBJECT_ID_COLUMNS = ("SUBJID", "USUBJID")
ROLE_LABELS = {
    "x": "X-axis (linear)",
    "subject": "Y-axis (categorical)",
    "bar": "HBAR duration",
}


@dataclass(frozen=True)
class Roles:
    subject: str = ""
    x: str = ""
    bar: str = ""
    overlays: tuple[str, ...] = field(default_factory=tuple)
    keep: tuple[str, ...] = field(default_factory=tuple)

    def required(self) -> list[str]:
        """Non-empty role columns in the order subject, x, bar."""
        return [c for c in (self.subject, self.x, self.bar) if c]

    def missing_labels(self) -> list[str]:
        """Labels of roles that are not given, in the order x, subject, bar."""
        return [ROLE_LABELS[r] for r in ("x", "subject", "bar") if not getattr(self, r)]
