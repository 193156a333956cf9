"""Small builders shared by tests."""

PUB_SCHEMA = (
    "pmid string, title string, abstract_text string, abstract_sections map<string,string>, authors array<string>, "
    "pub_year string, journal string, mesh_terms array<string>, pub_types array<string>, secondary_ids array<string>"
)
TRIAL_SCHEMA = "nct_id string, official_title string, brief_title string, completion_date string, ctgov_pmid string"
EMPTY = {"mesh_terms": [], "pub_types": ["Randomized Controlled Trial"], "secondary_ids": [], "abstract_sections": None}


def publication(pmid, title="", text="abstract", year="2020", **more):
    row = {**EMPTY, **more}
    return (pmid, title, text, row["abstract_sections"], ["Doe"], year, "J", row["mesh_terms"], row["pub_types"], row["secondary_ids"])
