"""DuckDB SQL for the registered queries, put together from named parts."""

from __future__ import annotations

import re

from helixmill.plans.bindings import VIEWS

CANDIDATES = "'S0','S2','S4','S6','S8','S10','S12','S14'"

#: Parts, each using those before it.
PARTS = VIEWS | {
    "c_bases_f": """select species, sum(read_len)::bigint as bases from b_class where species <> 'U' group by 1
        having count(*) filter (where mapq = 60) > 0 and count(*) filter (where mapq between 3 and 60) > count(*) / 10.0""",
    "c_profile": """select species as species_taxid, cov / sum(cov) over () as predicted_abundance, cov as predicted_coverage
        from (select species, bases / len as cov from c_bases_f left join b_len using (species))""",
    "c_local": """select species, 1::bigint as "start", ord % 7 + 3 as "end", is_pan, ord from b_range""",
    "c_rebased": """select species, ("start" + o)::bigint as "start", ("end" + o)::bigint as "end", is_pan from (select *, coalesce(sum("end") over (order by is_pan desc, ord rows between unbounded preceding and 1 preceding), 0) as o from c_local)""",
    "c_v0": "select rid, species, len(ids) as n, read_end - read_start as span, read_start, read_end, unnest(ids) as node_id, (generate_subscripts(ids, 1) - 1)::int as pos from b_class where species <> 'U'",
    "c_v1": "select v.*, node_len, case when pos = 0 then node_len - read_start else node_len end as ahead from c_v0 v join b_node using (species, node_id) where n > 1 or span >= 0",
    "c_v2": "select *, coalesce(sum(ahead) over (partition by species, rid order by pos rows between unbounded preceding and 1 preceding), 0) as seen from c_v1",
    "c_visit": """select rid, species, pos, node_id, node_len,
        (case when n = 1 then span when pos = n - 1 then greatest(span, seen) - seen else ahead end)::bigint as bases,
        row_number() over (partition by species, rid, node_id order by pos) = 1 as "first",
        case when pos = 0 then read_start else 0 end as low,
        (case when n = 1 then (case when read_start < read_end and read_end <= node_len then read_end end)
              when pos = n - 1 then least(greatest(span, seen) - seen, node_len) else node_len end)::bigint as high from c_v2""",
    "c_depth": """select species, node_id, node_len, coalesce(s, 0)::bigint as bases, coalesce(s, 0) / node_len as depth from b_node
        left join (select species, node_id, sum(bases) as s from c_visit where "first" group by 1, 2) using (species, node_id)""",
    "c_cover": """select species, node_id, count(distinct p) as covered from (select species, node_id, unnest(range(low, high)) as p from c_visit where high > low) group by 1, 2""",
    "c_breadth": "select species, node_id, coalesce(covered, 0)::bigint as covered from b_node left join c_cover using (species, node_id)",
    "c_trio": """select species, hap_id, pos, least(x, z) as a, y as b, greatest(x, z) as c from
        (select species, hap_id, pos, node_id as x, lead(node_id, 1) over w as y, lead(node_id, 2) over w as z from b_walk window w as (partition by species, hap_id order by pos)) where z is not null""",
    "c_unique": "select species, a, b, c, min(hap_id) as hap_id from c_trio group by 1, 2, 3, 4 having count(*) = 1",
    "c_triohap": """select u.species, a, b, c, hap_id, x.node_len + y.node_len + z.node_len as trio_len from c_unique u
        join b_node x on x.species = u.species and x.node_id = a join b_node y on y.species = u.species and y.node_id = b join b_node z on z.species = u.species and z.node_id = c""",
    "c_own": """select v.rid, v.species, v.pos, v.node_id, f.bases as own from c_visit v join c_visit f on f.rid = v.rid and f.species = v.species and f.node_id = v.node_id and f."first" """,
    "c_steps": """select species, node_id as x, lead(node_id, 1) over w as y, lead(node_id, 2) over w as z, own + lead(own, 1) over w + lead(own, 2) over w as t
        from c_own window w as (partition by species, rid order by pos)""",
    "c_triodepth": """select species, a, b, c, hap_id, trio_len, coalesce(s, 0)::bigint as bases, coalesce(s, 0) / trio_len as depth from c_triohap
        left join (select species, least(x, z) as a, y as b, greatest(x, z) as c, sum(t) as s from c_steps where z is not null group by 1, 2, 3, 4) using (species, a, b, c)""",
    "c_zmean": """select species, hap_id, coalesce(avg(depth) filter (where sd > 1e-12 and abs(depth - mu) < 3.0 * sd), 0.0) as mean from
        (select *, avg(depth) over w as mu, stddev_pop(depth) over w as sd from c_triodepth where depth > 0 window w as (partition by species, hap_id)) group by 1, 2""",
    "c_share": "select species, hap_id, (count(*) filter (where depth > 0))::double / count(*) as share from c_triodepth group by 1, 2",
    "c_first": "select species, hap_id, round(share, 2) as fraction, coalesce(mean, 0.0) as mean, share from c_share left join c_zmean using (species, hap_id)",
    "c_pathcov": """select species, hap_id, sum(covered) / sum(node_len) as path_base_cov from (select distinct species, hap_id, node_id from b_walk)
        join b_node using (species, node_id) join c_breadth using (species, node_id) group by 1, 2""",
    "c_single": "select species, hap_id, quantile_disc(depth, 0.5) as first_sol from (select distinct species, hap_id, node_id from b_walk) join c_depth using (species, node_id) where depth > 0 group by 1, 2",
    "c_metrics": """select species, hap_id, fraction, mean, path_base_cov, first_sol from c_first join c_pathcov using (species, hap_id) join c_single using (species, hap_id) where share >= 0.3""",
    "c_judged": """select *, coalesce(mean <> 0 and first_sol <> 0 and (divergence <= 0.46 or (divergence <= 0.6 and fraction * path_base_cov >= 0.85)), false) as keep,
        coalesce(mean <> 0 and first_sol <> 0 and divergence > 0.46 and divergence <= 0.6 and fraction * path_base_cov >= 0.85, false) as is_rescue
        from (select *, case when mean <> 0 then round(abs(first_sol - mean) / (first_sol + mean), 2) end as divergence from c_metrics)""",
    "c_cov": "select species, bases / len as coverage from (select species, sum(read_len)::bigint as bases from b_class where species <> 'U' group by 1) left join b_len using (species)",
    "c_plain": """select species, hap_id, pos, node_id from b_walk where hap_id = 'H0' or (hap_id = 'H1' and substr(species, 2)::bigint % 3 = 2)
        union all select species, hap_id || 'x', pos, node_id from b_walk where (hap_id = 'H0' and substr(species, 2)::bigint % 3 > 0) or (hap_id = 'H1' and substr(species, 2)::bigint % 3 = 2)""",
    "c_pmean": "select species, round(avg(depth) filter (where depth > 0), 2) as m from c_depth group by 1",
    "c_ptrio": """select species, least(x, z) as a, y as b, greatest(x, z) as c, count(*) as n from (select species, node_id as x, lead(node_id, 1) over w as y, lead(node_id, 2) over w as z
        from c_plain window w as (partition by species, hap_id order by pos)) where z is not null group by 1, 2, 3, 4""",
    "c_ppath": "select species, hap_id, list(node_id order by pos) as p from c_plain group by 1, 2",
    "c_pspec": "select species, count(*) as haps, count(distinct p) as paths, min(hap_id) as f from c_ppath group by 1",
    "c_edges": "select query as a, refer as b from b_sim where ani >= 30 union select refer, query from b_sim where ani >= 30",
    "c_reach": "select vec_id as a, vec_id as r from embeddings union select e.b, c_reach.r from c_reach join c_edges e on e.a = c_reach.a",
    "c_comp": "select label, g.genome, min(r) as component from b_genome g join c_reach on c_reach.a = g.genome group by 1, 2",
    "c_reps": "select label, component, arg_max(genome, row(is_ref::int, n50, -genome)) as genome from c_comp join b_genome using (label, genome) group by 1, 2",
    "c_both": "select label, query, refer, ani from b_sim union all select label, refer, query, ani from b_sim",
    "c_inside": """select s.label, p.component as cluster, query, round(avg(100 - ani), 6) as dist from c_both s join c_comp p on p.label = s.label and p.genome = query
        join c_comp q on q.label = s.label and q.genome = refer where p.component = q.component group by 1, 2, 3""",
    "c_medoid": """select label, cluster, case when n <= 2 then f else best end as genome from (select label, component as cluster, count(*) as n, min(genome) as f from c_comp group by 1, 2)
        left join (select label, cluster, arg_min(query, row(dist, query)) as best from c_inside group by 1, 2) using (label, cluster)""",
    "c_file": "select p_partkey, 'GCF_' || p_partkey || '.' || p_size || '_' || replace(p_name, ' ', '_') || '_genomic.fna.gz' as base from part",
    "c_igram": "select distinct item_id, array_to_string(w[i : i + 4], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 3)) as i from (select item_id, string_split(text, ' ') as w from benchmark))",
    "c_dgram": "select distinct array_to_string(w[i : i + 4], ' ') as gram from (select w, unnest(range(1, len(w) - 3)) as i from (select string_split(text, ' ') as w from documents))",
}


#: The bound strains: the parts on walks once more, over walks whose best fits are unique.
_MOVED = ("b_walk", "c_trio", "c_unique", "c_triohap", "c_triodepth", "c_zmean", "c_share", "c_first", "c_pathcov", "c_single")


def _moved(text: str) -> str:
    return re.sub(r"\b(" + "|".join(_MOVED) + r")\b", lambda m: "s" + m[0][1:], text)


PARTS |= {
    "s_walk": """select species, hap_id, (row_number() over (partition by species, hap_id order by node_id) - 1)::int as pos, node_id from
        (select species, node_id, substr(species, 2)::bigint % 4 as kind, (node_id - 1) % 100 as k, unnest(['H0', 'H1']) as hap_id from b_node)
        where kind = 2 or (kind = 0 and hap_id = 'H0') or (kind = 1 and (hap_id = 'H0') = (k < 45)) or (kind = 3 and k < 4 and (hap_id = 'H0') = (k < 2))""",
    **{"s" + name[1:]: _moved(PARTS[name]) for name in _MOVED[1:]},
    "s_cov": "select * from c_cov where coverage is not null",
    "s_path": "select species, hap_id, list(node_id order by pos) as p from s_walk group by 1, 2",
    "s_kind": """select species, n, f, n = 1 or species not in (select species from s_unique) as plain, n = 1 or paths = 1 as single
        from (select species, count(*) as n, count(distinct p) as paths, min(hap_id) as f from s_path group by 1)""",
    "s_possible": """select f.species, f.hap_id, f.fraction, f.mean, false as plain from s_first f join s_kind using (species) where not plain and share >= 0.3
        union all select species, f, null, coalesce(m, 0.0), true from s_kind left join c_pmean using (species) where plain and single
        union all select k.species, p.hap_id, null, null, true from s_kind k join s_path p using (species) where plain and not single""",
    "s_solved": """select p.species, p.hap_id, p.fraction, p.mean, p.plain, path_base_cov, coalesce(first_sol, 0.0) as first_sol,
        case when mean <> 0 then round(abs(coalesce(first_sol, 0.0) - mean) / (coalesce(first_sol, 0.0) + mean), 2) end as gap from s_possible p left join s_pathcov using (species, hap_id) left join s_single using (species, hap_id)""",
    "s_judged": """select *, not plain and coalesce(mean <> 0 and first_sol <> 0 and gap > 0.46 and gap <= 0.6 and fraction * path_base_cov >= 0.85, false) as is_rescue,
        not plain and coalesce(mean <> 0 and first_sol <> 0 and (gap <= 0.46 or (gap <= 0.6 and fraction * path_base_cov >= 0.85)), false) as keep from s_solved""",
    "s_every": """select h.species, h.hap_id, coalesce(j.fraction, f.fraction) as fraction, j.mean, j.path_base_cov, j.first_sol, case when not plain or j.mean > 0 then gap end as divergence, coverage,
        coalesce(is_rescue, false) as is_rescue, case when plain then (case when j.mean is null or j.mean > 0 then j.first_sol end) when keep then j.first_sol end as s2
        from (select distinct species, hap_id from s_walk) h join s_cov using (species) left join s_judged j using (species, hap_id) left join (select f.* from s_first f join s_kind using (species) where not plain) f using (species, hap_id)""",
    "s_con": """select species, hap_id, fraction, mean, path_base_cov, first_sol, divergence, is_rescue, abs(tot - coverage) / ((tot + coverage) / 2) as total_cov_diff, size,
        case when top > 1.05 * coverage and not is_rescue then s2 * coverage / tot else s2 end as second_sol
        from (select *, sum(coalesce(s2, 0)) over (partition by species) as tot, max(s2) over (partition by species) as top, count(*) over (partition by species) as size from s_every)""",
    "t_walk": "select * from b_walk where hap_id in ('H0', 'H1')",
    "c_pair": """select species, a, b, depth as d, count(*) as n from (select species, node_id, max((hap_id = 'H0')::int) as a, max((hap_id = 'H1')::int) as b from b_walk where hap_id in ('H0', 'H1') group by 1, 2)
        join c_depth using (species, node_id) where depth > 0 group by 1, 2, 3, 4""",
}

#: The strain parts over two haplotypes that share nodes.
_SHARED = ("trio", "unique", "triohap", "triodepth", "zmean", "share", "first", "path", "kind", "possible")
PARTS |= {f"t_{name}": re.sub(rf"\bs_(walk|{'|'.join(_SHARED)})\b", r"t_\1", PARTS[f"s_{name}"]) for name in _SHARED}
PARTS |= {
    "t_node": """select species, a, b, depth as d, count(*) as n from (select species, node_id, max((hap_id = 'H0')::int) as a, max((hap_id = 'H1')::int) as b from t_walk join t_possible using (species, hap_id) group by 1, 2)
        join c_depth using (species, node_id) where depth > 0 and species in (select species from s_cov) group by 1, 2, 3, 4""",
}


def _table(limit: float | None, digits: int) -> str:
    """The strain report of the bound strains."""
    rows = "s_con" if limit is None else f"(select * from s_con where (size > 1 or total_cov_diff <= {limit}) and second_sol >= 0 and second_sol <> 0)"
    value = lambda name, to: f"round({name}, {digits}) as {to}"
    return f"""select species as species_taxid, species || '.' || substr(hap_id, 2, 1) as strain_taxid, species || '-' || hap_id as "genome_ID", {value("second_sol", "predicted_coverage")},
        {value("second_sol / sum(second_sol) over ()", "predicted_abundance")}, {value("path_base_cov", "path_base_cov")}, {value("fraction", "unique_trio_fraction")}, {value("mean", "uniq_trio_cov_mean")},
        {value("first_sol", "first_sol")}, {value("divergence", "strain_cov_diff")}, {value("total_cov_diff", "total_cov_diff")} from {rows}"""


def _stats(rows: str, keys: str, n_letters: str, gc_letters: str, ceil: str) -> str:
    """Sequence statistics of rows (keys, seq)."""
    return f"""with s as ({rows}), l as (select {keys}, length(seq)::bigint as len, length(regexp_replace(seq, '[^{n_letters}]', '', 'g')) as nn, length(regexp_replace(seq, '[^{gc_letters}]', '', 'g')) as gc from s),
        r as (select {keys}, len, sum(len) over (partition by {keys} order by len desc rows between unbounded preceding and current row) as cum, sum(len) over (partition by {keys}) as tot from l),
        x as (select {keys}, max(len) filter (where cum >= {ceil}(tot * 0.5)) as n50, max(len) filter (where cum >= {ceil}(tot * 0.9)) as n90 from r group by {keys})
        select {keys}, count(*) as n, sum(len)::bigint as total, sum(nn)::bigint as gap, round(avg(len), 6) as avg, any_value(n50) as n50, any_value(n90) as n90, max(len) as longest, min(len) as shortest,
        round(100.0 * sum(gc) / nullif(sum(len) - sum(nn), 0), 6) as gc from l join x using ({keys}) group by {keys}"""


_SEQ = "select source as genome, text as seq from documents"
_CONTIG = "select genome, seq from (select source as genome, unnest(regexp_split_to_array(text, 'N+')) as seq from documents) where length(seq) >= {}"
_SHORT = "array_to_string(string_split({0}, '_')[1:2], '_')"

_FINAL = {
    "jn1_range_classify": "select rid, species from b_class",
    "jn1_bucketed_classify": "select rid, species from b_class",
    "jn1b_overlap_any": """select rid, (select arg_min(g.species, g.ord) from b_range g where r.mn between g."start" and g."end" or r.mx between g."start" and g."end") as species from b_read r""",
    "ag7_dup_reads": """select rid, case when k = 1 then read_id else read_id || '_' || k end as unique_id, species from (select rid, read_id, species, row_number() over (partition by read_id order by rid) as k
        from b_class where read_id in (select read_id from b_class group by 1 having count(distinct species) = 1))""",
    "ag8_best_alignment": """select read_id, rid, matches, round(identity, 6) as identity, mapq, span from (select *, row_number() over (partition by read_id order by rid) as k from
        (select *, rank() over (partition by read_id order by matches desc, identity desc) as best from b_read) where best = 1 and mapq > 20 and span > 1000) where k = 1""",
    "ag1_equal_len_unfiltered": "select species, (count(*) * 150)::bigint as bases from b_class where species <> 'U' group by 1",
    "ag1_equal_len_filtered": """select species, (count(*) * 150)::bigint as bases from b_class where species <> 'U' group by 1
        having count(*) filter (where mapq = 60) > 0 and count(*) filter (where mapq between 3 and 60) > count(*) / 10.0""",
    "ag2_var_len_unfiltered": "select species, sum(read_len)::bigint as bases from b_class where species <> 'U' group by 1",
    "ag2_var_len_filtered": "select species, bases from c_bases_f",
    "ag5_species_profile": "select species_taxid, round(predicted_abundance, 9) as predicted_abundance, round(predicted_coverage, 9) as predicted_coverage from c_profile",
    "jn4_candidate_species": f"""select species_taxid as species, round(predicted_abundance, 9) as predicted_abundance, round(predicted_coverage, 9) as predicted_coverage, "start", "end"
        from c_profile join b_range on species = species_taxid where predicted_abundance > 1e-4 and is_pan = 0 and species in ({CANDIDATES})""",
    "sk2_read_report": "select read_id, mapq, species, read_len from b_class",
    "rg1_rebase": "select * from c_rebased",
    "rg2_from_counts": """select species, (e - n + 1)::bigint as "start", e::bigint as "end", is_pan from (select *, sum(n) over (order by ord) as e from (select species, ord % 7 + 3 as n, is_pan, ord from b_range where ord % 5 <> 4))""",
    "rg3_merge_db": """with t as (select max("end") as t from c_rebased) select species, "start", "end", is_pan from c_rebased
        union all select 'T' || species, "start" + t, "end" + t, is_pan from c_rebased, t union all select 'V' || species, "start" + 2 * t, "end" + 2 * t, is_pan from c_rebased, t""",
    "gr2_node_bounds": "select rid, mn as low, mx as high from b_read",
    "gr3_trios": "select * from c_trio",
    "ag12_unique_trios": "select * from c_unique",
    "gr6_trio_hap": "select * from c_triohap",
    "gr4_read_nodes": "select * from c_visit",
    "ag9_node_depth": "select species, node_id, node_len, bases, round(depth, 6) as depth from c_depth",
    "ag10_node_breadth": "select * from c_breadth",
    "ag11_trio_depth": "select species, a, b, c, hap_id, trio_len, bases, round(depth, 6) as depth from c_triodepth",
    "gr7_incidence": "select distinct species, hap_id, node_id from b_walk",
    "ag15_path_breadth": "select species, hap_id, round(path_base_cov, 6) as path_base_cov from c_pathcov",
    "gr10_shift_nodes": """select species, node_id - (node_id - 1) // 100 * 100 + "start" - 1 as node_id, node_len from b_node join b_range using (species)""",
    "ag13_zscore_mean": "select species, hap_id, round(mean, 6) as mean from c_zmean",
    "ff1_first_filter": "select species, hap_id, fraction, round(mean, 6) as mean, share >= 0.3 as keep from c_first",
    "ff2_shift": "select species, hap_id, fraction, round(mean, 6) as mean, share >= (case when mean >= 1 then least(0.8, 0.3 + 0.5 * mean / 100) else 0.3 * mean end) as keep from c_first",
    "ff3_ff4_degenerate": """select p.species, p.hap_id, case when haps = 1 or paths = 1 then coalesce(m, 0.0) end as mean from c_ppath p join c_pspec using (species) left join c_pmean using (species)
        where (haps = 1 or p.species not in (select species from c_ptrio where n = 1)) and (not (haps = 1 or paths = 1) or p.hap_id = f)""",
    "opt1_single_path_median": "select species, hap_id, round(first_sol, 6) as first_sol from c_single",
    "sf1_second_filter": """select species, hap_id, fraction, round(mean, 6) as mean, round(path_base_cov, 6) as path_base_cov, round(first_sol, 6) as first_sol, divergence, keep, is_rescue from c_judged""",
    "cn_constraints": """select species, species || '_' || hap_id as hap_id, round(first_sol, 6) as first_sol, round(second_sol, 6) as second_sol, is_rescue, round(total_cov_diff, 6) as total_cov_diff from s_con where second_sol is not null""",
    "se1_strain_table": _table(5.0, 6),
    "sk4_unfiltered": _table(None, 6),
    "ou1_strain_metrics": """select species, hap_id, round(fraction, 6) as fraction, round(mean, 6) as mean, round(path_base_cov, 6) as path_base_cov, round(first_sol, 6) as first_sol, divergence,
        round(second_sol, 6) as second_sol, is_rescue, round(total_cov_diff, 6) as total_cov_diff from s_con""",
    "ou2_strain_profile": _table(0.2, 4),
    "pf10_min_depth": """select k.species, p.hap_id, case when single then coalesce(m, 0.0) end as mean from s_kind k join s_path p using (species)
        left join (select species, round(avg(depth) filter (where depth > 2), 2) as m from c_depth group by 1) using (species) where plain and (not single or p.hap_id = f)""",
    "opt1_lad_multi": "select distinct species, hap_id, true as feasible, 0.0::double as gap from b_walk join c_depth using (species, node_id) where depth > 0",
    "opt2_refit": """select distinct species, hap_id, true as feasible, 0.0::double as gap from b_walk join c_depth using (species, node_id) join (select species, hap_id from c_share where share >= 0.3) using (species, hap_id) where depth > 0""",
    "opt1_lad_pair": """, line as (select distinct species, a, b, d from c_pair union all select distinct species, 1, 0, 0.0 from c_pair union all select distinct species, 0, 1, 0.0 from c_pair),
        meet as (select distinct p.species, (p.d * q.b - q.d * p.b) / (p.a * q.b - p.b * q.a) as x, (p.a * q.d - q.a * p.d) / (p.a * q.b - p.b * q.a) as y from line p join line q using (species) where p.a * q.b - p.b * q.a <> 0)
        select species, round(min(o), 6) as objective from (select species, x, y, sum(n * abs(a * x + b * y - d)) / sum(n) as o from meet join c_pair using (species) where x >= -1e-9 and y >= -1e-9 group by 1, 2, 3) group by 1""",
    "ou3_shared_paths": """, line as (select distinct species, a, b, d from t_node union all select distinct species, 1, 0, 0.0 from t_node union all select distinct species, 0, 1, 0.0 from t_node),
        meet as (select distinct p.species, (p.d * q.b - q.d * p.b) / (p.a * q.b - p.b * q.a) as x, (p.a * q.d - q.a * p.d) / (p.a * q.b - p.b * q.a) as y from line p join line q using (species) where p.a * q.b - p.b * q.a <> 0)
        select species, any_value(haps) as haps, round(min(o), 6) as objective from (select species, count(*) as haps from t_possible group by 1) join (select species, x, y, sum(n * abs(a * x + b * y - d)) / sum(n) as o from meet join t_node using (species) where x >= -1e-9 and y >= -1e-9 group by 1, 2, 3) using (species) group by 1""",
    "opt1_lad_refined": """, line as (select distinct species, a, b, d from c_pair union all select distinct species, 1, 0, 0.0 from c_pair union all select distinct species, 0, 1, 0.0 from c_pair),
        meet as (select distinct p.species, (p.d * q.b - q.d * p.b) / (p.a * q.b - p.b * q.a) as x, (p.a * q.d - q.a * p.d) / (p.a * q.b - p.b * q.a) as y from line p join line q using (species) where p.a * q.b - p.b * q.a <> 0)
        select species, round(min(o), 6) as objective, 0.0::double as gap from (select species, x, y, sum(n * abs(a * x + b * y - d)) / sum(n) as o from meet join c_pair using (species) where x >= -1e-9 and y >= -1e-9 group by 1, 2, 3) group by 1""",
    "ag18_species_avg_len": "select lang as species, round(avg(n_chars), 6) as len from documents group by 1",
    "ag19_seq_stats": _stats(_SEQ, "genome", "Nn", "GgCc", "ceil"),
    "ag20_n50_ceil": f"select genome, n50, n90 from ({_stats(_SEQ, 'genome', 'Nn', 'GgCc', 'ceil')})",
    "ag20b_n50_py": _stats(_SEQ, "genome", "N", "GC", ""),
    "ag21_contigs": _stats(_CONTIG.format(500), "genome", "N", "GC", ""),
    "ag22_assembly_report": _stats(
        f"select genome, 'scaffold' as level, seq from ({_SEQ}) union all select genome, 'contig', seq from ({_CONTIG.format(1)}) union all select genome, 'long_contig', seq from ({_CONTIG.format(500)})",
        "genome, level", "N", "GC", "",
    ),
    "gr8_chunk_1024": """select genome, seq_id, i + 1 as node_id, length(c)::bigint as node_len, md5(c) as chunk_md5 from
        (select genome, seq_id, i, substr(seq, i * 1024 + 1, 1024) as c from (select *, unnest(range(0, ceil(length(seq) / 1024.0)::bigint)) as i from b_seq where length(seq) > 0))""",
    "ag27_genome_groups": "select source || '-' || lang as species, count(*) as genomes, (count(*) > 1)::int as is_pan from documents group by 1",
    "ag23_pair_max": "select label, query, refer, ani from b_sim where ani >= 20",
    "ag25_argmax": "select source, arg_max(doc_id, row(n_chars, -doc_id)) as doc_id, max(n_chars) as n_chars from documents group by 1",
    "gr12_components": "select * from c_comp",
    "gr13_representatives": "select * from c_reps",
    "gr15_fallback": """select label, genome from b_genome where is_ref and label % 2 = 0 union all select label, arg_max(genome, row(is_ref::int, n50, -genome)) from b_genome
        where label not in (select label from b_genome where is_ref and label % 2 = 0) group by 1""",
    "gr17_medoid": "select * from c_medoid",
    "gr18_reassign": """select label, genome, rep from (select b.label, query as genome, arg_max(refer, row(ani, -refer)) as rep from c_both b join c_medoid m on m.label = b.label and m.genome = refer
        where query not in (select genome from c_medoid) group by 1, 2) union all select label, genome, genome from c_medoid""",
    "jn13_rep_pairs": "select label, query, refer from b_sim where ani >= 20 and query in (select genome from c_reps) and refer in (select genome from c_reps)",
    "jn14_expand_clusters": "select label, genome, component as cluster from c_comp where (label, component) in (select label, component from c_comp join b_genome using (label, genome) where is_ref)",
    "sc19_filter_matrix": "select query as i, refer as j, round(100 - ani, 6) as dist from b_sim where query in (select genome from b_genome where n50 >= 500) and refer in (select genome from b_genome where n50 >= 500)",
    "wn7_top_m": "select label, genome, n50 from (select *, row_number() over (partition by label order by n50 desc, genome) as r from b_genome) where r <= 5",
    "gr19_containment": "select item_id, count(*) as grams, count(d.gram) as shared, round(count(d.gram) / count(*), 6) as containment from c_igram i left join c_dgram d on d.gram = i.gram group by 1",
    "fn2_fn3_hap_id": f"select p_partkey, {_SHORT.format('base')} as hap_id from (select p_partkey, regexp_replace(base, '\\.[^.]*$', '') as base from c_file)",
    "fn4_file_stem": r"select page_id, case when b like '_%.%' then regexp_replace(b, '\.[^.]*$', '') else b end as stem from (select page_id, string_split(url, '/')[-1] as b from pages)",
    "fn5_genome_name": rf"select p_partkey, regexp_replace(base, '_genomic\.fna(\.gz)?$', '') as genome, {_SHORT.format('base')} as short_name from c_file",
    "sc14_fasta_suffix": """select p_partkey, regexp_matches(['.fa', '.fna.gz', '.fasta', '.fasta.gz', '.faa', '.fna.zip', 'fna', '.fa.gz'][p_size % 8 + 1], '\\.(fa|fna|fasta)(\\.gz)?$') as fasta from part""",
    "pf17_long_scaffolds": """select doc_id || case when doc_id % 7 = 0 then ' a Plasmid' else '' end as seq_id, length(text) as letters from documents where length(text) >= 1000 and doc_id % 7 <> 0""",
    "fn14_precise_clipping": """select rid from b_read where identity >= [0.75, 0.75, 0.8, 0.9, 0.66][read_start % 5 + 1]::double + 0.1::double""",
    "pf5_pangenomes": """select species, round(predicted_abundance, 9) as predicted_abundance, round(predicted_coverage, 9) as predicted_coverage, "start", "end" from c_every join b_range using (species) where predicted_abundance > 1e-4 and is_pan = 1""",
    "pf5_all_species": """select species, round(predicted_abundance, 9) as predicted_abundance, round(predicted_coverage, 9) as predicted_coverage, "start", "end" from c_every join b_range using (species) where predicted_abundance > 0.05""",
    "gr19_stored_index": "select genome, grams, shared, round(containment, 6) as containment, round(100 * pow(containment, 0.2), 6) as ani from c_sketched",
    "gr20_banded_pairs": """with g as (select distinct lang as label, doc_id as genome, array_to_string(w[i : i + 4], ' ') as gram from (select lang, doc_id, w, unnest(range(1, len(w) - 3)) as i from (select lang, doc_id, string_split(text, ' ') as w from documents))),
        e as (select label, min(genome) as genome, any_value(n) as n from (select label, genome, count(*) as n, list(gram order by gram) as grams from g group by 1, 2) group by label, grams),
        r as (select g.* from g semi join e using (label, genome)),
        p as (select x.label, x.genome as query, y.genome as refer, count(*) as shared from r x join r y on x.label = y.label and x.gram = y.gram and x.genome < y.genome group by 1, 2, 3),
        q as (select p.*, shared / (x.n + y.n - shared) as j from p join e x on x.label = p.label and x.genome = query join e y on y.label = p.label and y.genome = refer)
        select label, query, refer, shared, round(100 * (1 + ln(2 * j / (1 + j)) / 5), 6) as ani from q where 100 * (1 + ln(2 * j / (1 + j)) / 5) >= 95""",
    "fast_filter": """select 'G' || item_id as "genome_ID", genome as id from benchmark join c_sketched on genome = '/g/' || item_id || '.fna' where 100 * pow(containment, 0.2) >= 60""",
    "fn12_strain_suffix": """select s_suppkey, case when count(*) over (partition by t) > 1 then t || '.' || row_number() over (partition by t order by s_suppkey) else t::varchar end as strain_taxid
        from (select s_suppkey, s_nationkey * 3 + s_suppkey % 2 as t from supplier)""",
    "fn13_threads": """select p_size, count(*) as n, least(ceil((case when p_size < 5 then 8 when p_size <= 10 then 16 when p_size <= 25 then 32 when p_size <= 50 then 48 else 64 end) * 1.5), 80)::int as threads from part group by 1""",
    "pf14_case": "select p_partkey, array_to_string(string_split(replace(p_name, ' ', '_'), '_')[1:2], '_') as name from part",
    "so4_sample": """select species, node_id, round(depth, 6) as depth from (select *, row_number() over (partition by species order by (node_id * 48271 + 42) % 2147483647, node_id) as r from c_depth where depth > 0) where r <= 20""",
    "so7_hap_index": "select species, hap_id, (dense_rank() over (partition by species order by hap_id) - 1)::int as path_index from (select distinct species, hap_id from b_walk)",
}


_FINAL |= {
    "gr14_cliques": """, rep as (select label, genome, is_ref from c_reps join b_genome using (label, genome)), edge as (select label, query as a, refer as b from b_sim where ani >= 20
            and query in (select genome from rep) and refer in (select genome from rep)),
        k2 as (select label, [a, b] as c from edge), k3 as (select k.label, list_append(c, y.b) as c from k2 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b),
        k4 as (select k.label, list_append(c, z.b) as c from k3 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b join edge z on z.a = c[3] and z.b = x.b),
        k5 as (select k.label, list_append(c, z.b) as c from k4 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b join edge z on z.a = c[3] and z.b = x.b join edge w on w.a = c[4] and w.b = x.b),
        k as (select label, [genome] as c from rep union all select * from k2 union all select * from k3 union all select * from k4 union all select * from k5),
        best as (select label, c, row_number() over (partition by label order by len(list_filter(c, lambda x: list_contains(refs, x))) > 0 desc, len(c) desc, c) as r from k join (select label, list(genome) filter (where is_ref) as refs from rep group by 1) using (label))
        select label, unnest(c) as genome from best where r = 1""",
    "lc_thin_out": """, rep as (select label, genome, is_ref from c_reps join b_genome using (label, genome)), edge as (select label, query as a, refer as b from b_sim where ani >= 20
            and query in (select genome from rep) and refer in (select genome from rep)),
        k2 as (select label, [a, b] as c from edge), k3 as (select k.label, list_append(c, y.b) as c from k2 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b),
        k4 as (select k.label, list_append(c, z.b) as c from k3 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b join edge z on z.a = c[3] and z.b = x.b),
        k5 as (select k.label, list_append(c, z.b) as c from k4 k join edge x on x.a = c[1] join edge y on y.a = c[2] and y.b = x.b join edge z on z.a = c[3] and z.b = x.b join edge w on w.a = c[4] and w.b = x.b),
        k as (select label, [genome] as c from rep union all select * from k2 union all select * from k3 union all select * from k4 union all select * from k5),
        best as (select label, c, row_number() over (partition by label order by len(list_filter(c, lambda x: list_contains(refs, x))) > 0 desc, len(c) desc, c) as r from k join (select label, list(genome) filter (where is_ref) as refs from rep group by 1) using (label))
        select 'G' || lpad(genome::varchar, 8, '0') as "genome_ID", label::varchar as species_taxid from (select label, unnest(c) as genome from best where r = 1)""",
    "lc_linkage": """select 'G' || lpad(genome::varchar, 8, '0') as "genome_ID", label::varchar as species_taxid from c_medoid""",
    "lc_profile_sample": _table(0.2, 4),
    "lc_merge_databases": """, t as (select max("end") as t from b_range) select species, "start", "end", is_pan from b_range union all select species, "start" + t, "end" + t, is_pan from b_range, t where species in ('S1', 'S2', 'S5')""",
    "gr16_linkage_conditions": "select label, count(*) as genomes, true as compact, 0::bigint as mergeable from b_genome group by 1",
    "ag24_cluster_lists": "select label, component as cluster, array_to_string(list(genome order by genome), ',') as genomes, count(*)::int as size from c_comp group by 1, 2",
    "jn15_reference": "select label, min(genome) filter (where is_ref and label % 3 > 0) as reference from b_genome group by 1",
    "fn11_versions": "select p_partkey, (p_size % 4, p_partkey % 11) >= (2, 3) as enough from part",
    "sc1_sk10_genomes_info": "select * from c_info",
    "sc2_species_range": """select species, "start", "end", is_pan from b_range""",
    "sc3_gaf": "select * from c_gaf",
    "sc4_gaf_columns": "select read_id, path, mapq, read_len from c_gaf",
    "sc5_gaf_zero": "select * replace (coalesce(read_len, 0) as read_len) from c_gaf",
    "sc6_long_gaf": "select rid, read_id, mapq, matches, round(identity, 6) as identity, span from b_read where rid is not null",
    "sk9_filtered_gaf": """select read_id, mapq, matches, round(identity, 6) as identity, span from (select *, row_number() over (partition by read_id order by concat_ws(chr(9), span, '+', path, '9', read_start, read_end, matches, '4', mapq, rid)) as k from
        (select *, rank() over (partition by read_id order by matches desc, identity desc) as best from b_read) where best = 1 and mapq > 20 and span > 1000) where k = 1""",
    "sc7_species_lengths": "select * from b_len",
    "sc8_sk2_read_classes": "select read_id, mapq, species, read_len from b_class",
    "sc9_sk3_species_report": "select species_taxid, round(predicted_abundance, 9) as predicted_abundance, round(predicted_coverage, 9) as predicted_coverage from c_profile",
    "sk5_rounded_report": "select species_taxid, round(predicted_abundance, 2) as predicted_abundance, round(predicted_coverage, 2) as predicted_coverage from c_profile",
    "sc10_gfa_nodes": "select species, local as node_id, node_len from c_local_node",
    "sc10_gfa_walks": "select species, hap_id, pos, local as node_id from b_walk join c_local_node using (species, node_id)",
    "sc10_long_walks": "select species, hap_id, pos, local as node_id from b_walk join c_local_node using (species, node_id)",
    "sc11_gfa_oriented": "select species, hap_id, pos, local as node_id from b_walk join c_local_node using (species, node_id)",
    "sc11_graph_ranges": """select species, min(local) as "start", max(local) as "end", (any_value(h) > 1)::int as is_pan from c_local_node left join (select species, count(distinct hap_id) as h from b_walk group by 1) using (species) group by 1""",
    "sc12_sk7_stored_graph": "select * from b_node where species in ('S1', 'S3', 'S4')",
    "rg4_merge_graphs": "select species, node_id, node_len + (species in ('S1', 'S2'))::int as node_len from b_node",
    "sc13_sk11_fasta": "select source || '_x#0#' || doc_id as seq_id, upper(md5(text)) as seq from documents where text is not null",
    "sk8_linear_gfa": """with q as (select source as genome, doc_id as seq_id, regexp_replace(text, '[^a-z]', 'a', 'g') as seq from documents where doc_id % 10 = 0), n as (select *, ceil(length(seq) / 1024.0)::bigint as n from q where length(seq) > 0),
        line as (select 'H	VN:Z:1.1' as value from q union all select 'S	' || i || '	' || substr(seq, (i - 1) * 1024 + 1, 1024) from (select *, unnest(range(1, n + 1)) as i from n)
            union all select 'L	' || i || '	+	' || (i + 1) || '	+	0M' from (select *, unnest(range(1, n)) as i from n)
            union all select 'W	' || genome || '	0	' || seq_id || '	0	' || length(seq) || '	>' || array_to_string(range(1, n + 1), '>') from n)
        select value[1] as kind, count(*) as lines, sum(length(value))::bigint as chars from line group by 1""",
    "sc15_assembly_summary": """select p_partkey::varchar as taxid, (p_partkey // 100)::varchar as species_taxid, p_name as organism, 'Complete Genome' as level, p_size % 5 = 0 as is_ref, 'GCF_' || p_partkey || '_genomic.fna' as file
        from part where p_size % 2 = 0 and p_partkey // 100 in (1, 2, 3) and p_partkey % 3 = 0""",
    "sc16_gtdb": "select distinct 'GCF_' || p_partkey as accession, replace(p_name, ' ', '_') as species, 'Complete Genome' as level, 'A' || p_size as assembly, p_name as organism from part",
    "sc17_ani_pairs": "select query::varchar as query, refer::varchar as refer, ani from b_sim where ani >= 10",
    "sc18_ani_matrix": """select replace(a.n_name, ' ', '_') as i, replace(b.n_name, ' ', '_') as j, case when a.n_nationkey = b.n_nationkey then 0.0::double else (50 - (greatest(a.n_nationkey, b.n_nationkey) * 7 + least(a.n_nationkey, b.n_nationkey) * 3) % 50)::double end as dist from nation a, nation b""",
    "sc20_genome_stats": "select p_partkey::bigint as n, (p_size * 500000)::bigint as gap, (p_partkey % 4)::bigint as n50 from part where p_partkey % 4 > 0 and p_size < 20",
    "sc21_listing": """select (14 + sum(length(species || "start") + 2))::bigint as length from b_range""",
    "jn11_with_info": """select 'GCF_' || (p_partkey + 50) as "genome_ID", p_size as n50, i.* exclude ("genome_ID") from part left join c_info i on i."genome_ID" = 'GCF_' || (p_partkey + 50)""",
    "pf13_in_set": """select i.* from c_info i where "genome_ID" in (select 'GCF_' || p_partkey from part where p_size > 25)""",
}

PARTS |= {
    "c_every": """select species, cov / sum(cov) over () as predicted_abundance, cov as predicted_coverage from (select species, bases / len as cov from
        (select species, sum(read_len)::bigint as bases from b_class where species <> 'U' group by 1) left join b_len using (species))""",
    "c_low": "select *, ('0x' || substr(md5(gram), 1, 15))::bigint < 1152921504606846976 // 4 as low from (select gram from c_igram union select gram from c_dgram)",
    "c_sketched": """select '/g/' || item_id || '.fna' as genome, count(*) as grams, count(d.gram) as shared, count(d.gram) / count(*) as containment from c_igram i join c_low using (gram) left join c_dgram d on d.gram = i.gram where low group by 1""",
    "c_info": """select 'GCF_' || p_partkey as "genome_ID", (p_partkey // 100) || '.' || (p_partkey % 100) || '0' as strain_taxid, (p_partkey // 100)::varchar as species_taxid, p_name as organism_name, '/g/GCF_' || p_partkey || '.fna' as id from part""",
    "c_gaf": """select rid as read_id, case when k % 11 > 0 then read_len end as read_len, case when k % 7 > 0 then path end as path, 9::bigint as path_len, read_start::bigint as read_start, read_end::bigint as read_end, mapq::bigint as mapq
        from (select *, ((read_end % 77) + 77) % 77 as k from b_read)""",
    "c_local_node": "select *, row_number() over (partition by species order by node_id) as local from b_node",
}


def _compose(final: str) -> str:
    """The parts that a query needs, in order, then the query; its own ``with`` is joined to them."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in re.findall(r"\b[bcst]_\w+", text):
            if name in PARTS and name not in needed:
                needed.add(name)
                add(PARTS[name])

    add(final)
    parts = ", ".join(f"{name} as ({PARTS[name]})" for name in PARTS if name in needed)
    if not parts:
        return final
    head = "with recursive" if "c_reach" in needed else "with"
    own = re.match(r"\s*(with\s+|,)", final)
    return f"{head} {parts}, {final[own.end() :]}" if own else f"{head} {parts} {final}"


ORACLE_SQL = {name: _compose(sql) for name, sql in _FINAL.items()}

# From files every alignment line is a read of its own; the bound reads repeat one id on the smallest tables.
ORACLE_SQL["lc_profile_sample"] = ORACLE_SQL["lc_profile_sample"].replace("l_partkey, l_suppkey) as rid", "l_partkey, l_suppkey, l_quantity) as rid")
