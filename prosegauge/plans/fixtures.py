"""Small invented inputs for what the large tables do not hold: the same rows for the
engine and for SQL."""

from __future__ import annotations

SENTENCES = (
    "Applications are reviewed by independent experts.",
    "The award will be made in September.",
    "The plan is being evaluated.",
    "Forms must not be submitted after the deadline.",
    "Applicants may get selected for an interview.",
    "Helpers are regularly identified by providers.",
    "The partnerships are well described.",
    "Use the method as defined by statute.",
    "Use the amount as specified by the handbook.",
    "See the page on getting registered.",
    "Applicants submit forms.",
    "They have submitted forms.",
    "The applicant is being responsible.",
    "You can get started before the review is complete.",
    "People who are uninsured or underinsured need help.",
    "Show that you are prepared to track data.",
    "The officers are involved in planning.",
    "These conditions are associated with poor outcomes.",
    "There are proposed changes in the budget.",
    "There are changes proposed by the board.",
    "There is no set limit on the amount.",
    "There was approved by noon a new plan.",
    "Here there are held.",
    "Applications aren't accepted after Friday.",
    "Costs weren’t approved.",
    "You're required to answer.",
    "I'm being asked, they're indeed chosen.",
    "The program is in need of staff.",
    "The applicant is indeed eligible.",
    "The application is indeed required.",
    "It's approved.",
    "The form is; reviewed later.",
    "As defined; by Friday the team answers.",
    "As approved, by Friday the team answers.",
    "An entity as defined by the charter is selected and is funded.",
    "Use it as approved fully and by the board.",
    "Use it as approved very fully by the board.",
    "Use it as approved now fully yet only by the board.",
    "Use it as approved now fully yet only not by the board.",
    "The text was never ever fully duly only read.",
    "The text was never ever fully duly read.",
    "IT WAS BROKEN",
    "It was (quite) éd broken.",
    "Was it so? It was: built.",
    "x",
    "",
)

TEXTS = (
    "Visit https://a.example.org/b/c. Apply now.",
    "Write to jane.doe@example.org today. She answers.",
    "Costs rose 1.5 percent to $1,200.50 in 2.3.4. Then they fell.",
    "See No. 5 of the list, e.g. the U.S. rules. Dr. Who and Ms. Poe agree.",
    "no. 7 is here. E.G. this one, etc. All at 5 p.m.",
    "• First item. ◦ Second item! ☐ Third?",
    "and/or – yes — no\\maybe. Done.",
    "He said “Stop.” Then (quietly) “Go!” he left.)",
    "1. One 2) Two (3) Three 1.2.3. Four",
    "A non breaking space. An　ideographic one.",
    "Wait... what?! Really?!? ok",
    "C3PO met R2-D2 at 10:30 for 5% of ²³ things.",
    "The schedule and UEI of Aaliyah's résumé are re-scheduled.",
    "Straße naïveté œuvre coöperate Ωmega.",
    "\"Quoted words.\" 'Single.' [Bracketed.] {Braced.}",
    "Ends without a mark",
    ". ! ?",
    "www.example.org/x.y is up. I.B.M. too. a.b. c.",
    "made table funded eyes the ate ale eye goes does agreed hated.",
    "   ",
    "",
)


def rows(values: tuple[str, ...]) -> list[tuple[int, str]]:
    return list(enumerate(values))


def sql_values(values: tuple[str, ...], name: str = "fixture") -> str:
    """CTE of the rows (id, t)."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    return f"{name}(id, t) AS (VALUES " + ", ".join(f"({k}::BIGINT, {quoted(v)})" for k, v in enumerate(values)) + ")"
