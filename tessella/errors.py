"""What a request is refused with, before any job runs."""


class RequestError(ValueError):
    """A request that cannot be evaluated; the message names the slot and the reason."""
