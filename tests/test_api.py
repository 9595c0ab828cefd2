import pytest

from conftest import SMALL
from finfacts.plans import api, dims
from finfacts.plans.fixtures import AS_OF, FixtureCatalog
from finfacts.plans.q_sector import classified


@pytest.mark.parametrize("label,spec", dims.METRIC_CATALOGUE)
def test_every_catalogue_metric_ranks(spark, label, spec):
    c = FixtureCatalog.get(spark, SMALL)
    df = api.top_companies(c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_rates"], classified(c),
                           spec, limit=10, as_of=AS_OF)
    rows = df.collect()
    assert len(rows) <= 10
    vals = [r["value"] for r in rows]
    assert vals == sorted(vals, reverse=True)


def test_sector_filter_and_empty_match(spark):
    c = FixtureCatalog.get(spark, SMALL)
    cl = classified(c)
    args = (c["fx_std"], c["fx_companies"], c["fx_primary_tickers"], c["fx_rates"], cl)
    hc = api.top_companies(*args, "income_statement|total_revenue", 10, sector="Health Care", as_of=AS_OF)
    hc_ciks = {r["cik"] for r in cl.where("sector = 'Health Care'").collect()}
    assert {r["cik"] for r in hc.collect()} <= hc_ciks
    assert api.top_companies(*args, "income_statement|total_revenue", 10, sector="No Such Sector", as_of=AS_OF).count() == 0
    with pytest.raises(ValueError):
        api.top_companies(*args, "income_statement|total_revenue", 0)
