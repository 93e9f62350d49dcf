"""botlens: chat-bot activity analytics as Spark DataFrame plans.

Every operator takes and returns DataFrames; nothing is collected to the
driver.  Time-dependent answers take an explicit ``as_of`` (see
``botlens.functions.clock``) so results are reproducible.
"""

from botlens.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
