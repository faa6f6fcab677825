"""minutebook: DataFrame operators over legislative and civic records."""

from minutebook.session import build_session, scratch_dir

__all__ = ["build_session", "scratch_dir"]
