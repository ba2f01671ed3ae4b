"""Column lists and schemas of transaction files.

The raw record's names (251 of them) and the behaviour features are parameters: a list, or a file with one name a line.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import types as T

# The columns in use, in the order of the processed files.
USED = """
pri_acct_no_conv tfr_dt_tm trans_at total_disc_at settle_tp settle_cycle block_id trans_fwd_st trans_rcv_st sms_dms_conv_in
cross_dist_in tfr_in_in trans_md source_region_cd dest_region_cd cups_card_in cups_sig_card_in card_class card_attr acq_ins_tp
fwd_ins_tp rcv_ins_tp iss_ins_tp acpt_ins_tp resp_cd1 resp_cd2 resp_cd3 resp_cd4 cu_trans_st sti_takeout_in trans_id trans_tp
trans_chnl card_media trans_id_conv trans_curr_cd conn_md msg_tp msg_tp_conv trans_proc_cd trans_proc_cd_conv mchnt_tp
pos_entry_md_cd pos_cond_cd pos_cond_cd_conv term_tp rsn_cd addn_pos_inf iss_ds_settle_in acq_ds_settle_in upd_in pri_cycle_no
disc_in fwd_settle_conv_rt rcv_settle_conv_rt fwd_settle_curr_cd rcv_settle_curr_cd acq_ins_id_cd_BK acq_ins_id_cd_RG
fwd_ins_id_cd_BK fwd_ins_id_cd_RG rcv_ins_id_cd_BK rcv_ins_id_cd_RG iss_ins_id_cd_BK iss_ins_id_cd_RG acpt_ins_id_cd_BK
acpt_ins_id_cd_RG settle_fwd_ins_id_cd_BK settle_fwd_ins_id_cd_RG settle_rcv_ins_id_cd_BK settle_rcv_ins_id_cd_RG
auth_id_resp_cd rcv_settle_at mchnt_cd term_id
""".split()

# Columns in use that are no categories; the last four came later than the labelled files.
LATER = "auth_id_resp_cd rcv_settle_at mchnt_cd term_id".split()
NOT_CATEGORIES = "pri_acct_no_conv tfr_dt_tm trans_at total_disc_at".split() + LATER

# Institutions whose codes are cut into bank and region.
INSTITUTIONS = "acq fwd rcv iss related acpt settle_fwd settle_rcv acct".split()

CATEGORIES = [c for c in USED if c not in NOT_CATEGORIES]
LABELLED_ALL = [*USED, "label"]
LABELLED = [*USED[:2], "day_week", "hour", *(c for c in USED[2:] if c not in LATER), "label"]
CODES = [f"{x}_ins_id_cd" for x in INSTITUTIONS]

FRAUD = T.StructType([T.StructField(c, T.StringType()) for c in "sys_tra_no pri_acct_no_conv mchnt_cd pdate fraud_tp".split()])
TRANSITIONS = T.StructType([T.StructField("card", T.StringType()), T.StructField("mchnt", T.StringType()), T.StructField("last_mchnt", T.StringType()), T.StructField("time_diff", T.DoubleType())])
TRANSFERS = "tfr_in_acct_no tfr_out_acct_no fwd_settle_at hp_settle_dt loc_trans_tm acpt_ins_id_cd trans_md cross_dist_in".split()
TRANSFER_NAMES = "srccard dstcard money date time acpt_ins_id_cd trans_md cross_dist_in".split()


def names_of(names: list[str] | str) -> list[str]:
    """A list of names as it is, or the names in a file, one a line."""
    return [x for x in Path(names).read_text().split() if x] if isinstance(names, str) else list(names)


def strings(names: list[str], kind: T.DataType | None = None) -> T.StructType:
    """A schema of nullable columns of one type, strings by default."""
    return T.StructType([T.StructField(n, kind or T.StringType()) for n in names])


def keyed_doubles(names: list[str]) -> T.StructType:
    """The first column a string, the others doubles."""
    return T.StructType([T.StructField(n, T.DoubleType() if i else T.StringType()) for i, n in enumerate(names)])


def indexed_names(behaviour: list[str]) -> list[str]:
    """Feature header: behaviour features, then an index column for each category."""
    return [*behaviour, *(f"{c}_idx" for c in CATEGORIES)]
