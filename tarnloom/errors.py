class SpecError(ValueError):
    """Every failure that a specification or its data can cause."""
