"""What can go wrong with lexicons, user words, configurations and documents."""


class HanloomError(ValueError):
    """Raised while a plan is built, on the driver."""


class ConfigError(HanloomError):
    """An unknown configuration."""


class SlotError(HanloomError):
    """An unknown table of the lexicon."""


class LexiconReadError(HanloomError):
    """A lexicon file can't be opened, unpacked or parsed."""


class LexiconVersionError(HanloomError):
    """A pack of a newer schema than this one reads."""

    def __init__(self, found: int, supported: int):
        super().__init__(f"lexicon schema {found} is newer than {supported}, the newest that is read here")
        self.found, self.supported = found, supported


class EntryError(HanloomError):
    """A custom entry or file that isn't valid; nothing was applied."""


class UserWordError(HanloomError):
    """A user word list that isn't valid; nothing was applied."""


class DocumentError(HanloomError):
    """An Office or EPUB container that can't be converted."""
