"""Requests that cannot be answered exactly are refused with a stable code."""


class Refused(ValueError):
    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code
