"""What an embedder may observe; successful calls only, and all methods do nothing by default."""


class Metrics:
    def record_put(self, seconds: float) -> None: ...

    def record_get(self, seconds: float) -> None: ...

    def record_delete(self, seconds: float) -> None: ...

    def record_merge(self, seconds: float) -> None: ...

    def record_sync(self, seconds: float) -> None: ...

    def record_pending_queue_depth(self, n: int) -> None: ...

    def record_merge_summary(self, files: int, copied: int) -> None: ...
