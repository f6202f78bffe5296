"""The one exception the library raises on purpose."""


class Refused(RuntimeError):
    """A measurement or a write that cannot be carried out honestly.

    A check which could not run must never read as a check which passed, so
    every guard in the library raises this and returns nothing.
    """
