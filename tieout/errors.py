"""Every guard raises one of these; none returns False."""


class TieoutError(Exception):
    """Root of the library's errors."""


class ControlTotalMismatch(TieoutError):
    """A file does not agree with what it declares."""


class Permanent(TieoutError):
    """A task failed in a way that a retry cannot mend."""


class Transient(TieoutError):
    """A task failed in a way that a retry may mend."""


class WorkflowError(TieoutError):
    """A break may not be changed this way."""


class ReviewError(TieoutError):
    """A maker-checker rule was not met."""


class NotAuthorised(TieoutError):
    """A closed period may not be rewritten."""


class LedgerTampered(TieoutError):
    """The event chain does not add up."""


class Conflict(TieoutError):
    """Somebody else has written what this would have replaced."""


class Claimed(TieoutError):
    """Another run works on this date."""
