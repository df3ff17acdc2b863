"""The whole analysis as one lazy plan: messages to the summary table and its statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrmail.functions import lexicon as L
from corrmail.operators import contacts, entities, merge, replies, rules, threads
from corrmail.operators.graph import stored


@dataclass(frozen=True)
class Options:
    """Word lists and choices of an analysis.

    ``use_threads``: thread membership relates a reply to outreach, and the addresses found so belong to the person
    from then on.  ``owner``: the owner's address, which then does not tie threads together.
    """

    subject_words: Sequence[str] = L.SUBJECT_KEYWORDS
    body_words: Sequence[str] = L.BODY_KEYWORDS
    reply_rules: L.ReplyRules = L.ReplyRules()
    domains: dict[str, str] | None = None
    use_threads: bool = False
    owner: str | None = None


class Analysis:
    """Steps over message rows, each built when it is asked for.

    What several steps read (messages, outreach, people, sent messages, replies) is stored: it runs once, later plans stay
    short, and a lost executor loses nothing.  Of a message to many, each recipient's row has the start of the body only.  ``overrides`` and ``analyses`` are logs; the
    newest entry of a field counts.
    """

    def __init__(self, messages: DataFrame, options: Options = Options(), overrides: DataFrame | None = None, analyses: DataFrame | None = None, excluded: DataFrame | None = None) -> None:
        self.messages = stored(messages.drop("body_html_text"))  # each step reads them
        self.options, self.analyses, self.excluded = options, analyses, excluded
        self.overrides = None if overrides is None else merge.override_pivot(overrides)

    @cached_property
    def scored(self) -> DataFrame:
        return contacts.score_contacts(self.messages, self.options.subject_words, self.options.body_words)

    @cached_property
    def outreach(self) -> DataFrame:
        body = F.substring(F.coalesce("body_text", F.lit("")), 1, entities.READ).alias("body_text")
        return stored(entities.contacts_by_recipient(self.scored).select("email", "id", "date", "to_text", "subject", body))

    @cached_property
    def people(self) -> DataFrame:
        return stored(entities.correspondents(self.outreach, self.options.domains))

    @cached_property
    def roles(self) -> DataFrame:
        return entities.message_roles(self.outreach)

    @cached_property
    def sent(self) -> DataFrame:
        return stored(replies.sent_to(self.people, self.roles, self.messages))

    @cached_property
    def _detected(self) -> tuple[DataFrame, DataFrame | None]:
        if not self.options.use_threads:
            return stored(replies.detect_replies(self.people, self.sent, self.messages)), None
        tree = stored(threads.build_threads(self.messages, self.options.owner))
        return replies.detect_with_addresses(self.people, self.sent, self.messages, tree)

    @property
    def replies(self) -> DataFrame:
        return self._detected[0]

    @property
    def addresses(self) -> DataFrame | None:
        """(email, seq, address) of each person, if threads may tell."""
        found = self._detected[1]
        return None if found is None else replies.all_addresses(self.people, found)

    @cached_property
    def status(self) -> DataFrame:
        forced = None if self.overrides is None else self.overrides.selectExpr("email", "status as value").filter("value is not null")
        return stored(replies.reply_status(self.people, self.sent, self.replies, self.messages, forced))

    @cached_property
    def my_status(self) -> DataFrame:
        return stored(replies.my_reply_status(self.people, self.replies, self.messages))

    @cached_property
    def ruled(self) -> DataFrame:
        return rules.classify(self.status.join(self.my_status, "email"), rules=self.options.reply_rules)

    def _merged(self, index: bool) -> DataFrame:
        latest = None if self.analyses is None else merge.latest_analysis(self.analyses)
        return merge.merged_table(self.people, self.status, self.my_status, self.ruled, latest, self.overrides, emails=self.addresses, excluded=self.excluded, index=index)

    @cached_property
    def merged(self) -> DataFrame:
        return self._merged(True)

    @cached_property
    def statistics(self) -> DataFrame:
        """Counts need no index, so no range partitioning."""
        return merge.statistics(self._merged(False), self.messages)


def analyze(messages: DataFrame, options: Options = Options(), **tables: DataFrame | None) -> Analysis:
    """The analysis of message rows; ``tables`` are overrides, analyses and excluded."""
    return Analysis(messages, options, **tables)
