"""From uploaded archives to pending tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from pageloom.session import stage
from pageloom.sources import archives as zips


def submit(
    archives: DataFrame,
    uploads: DataFrame,
    now: Column,
    max_images: int = zips.MAX_IMAGES,
    max_bytes: int = zips.MAX_IMAGE_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """(pending tasks, verdicts) of archives (archive, content) and uploads (archive, context_id, created_by).

    Archives are opened once: the entry list is staged, it is small and three steps read it.
    """
    entries = stage(zips.archive_entries(archives), "entries")
    verdicts = zips.validate_archives(archives.select("archive"), entries, max_images, max_bytes)
    named = zips.assign_object_names(zips.accepted_images(entries, verdicts))
    return zips.enqueue_tasks(named.join(uploads, "archive"), now), verdicts
