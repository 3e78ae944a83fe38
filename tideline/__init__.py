"""Subject-timeline analytics as lazy Spark DataFrame operators."""

from tideline.roles import Roles
from tideline.session import build_session, ensure_checkpoint_dir

__all__ = ["Roles", "build_session", "ensure_checkpoint_dir"]
